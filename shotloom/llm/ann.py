"""Nearest neighbours by inner product from balanced posting lists.

A vector of norm r gets one more component, the root of R^2 - r^2 with R the largest norm, and a query is stretched to
norm R with 0 there: the largest inner product then is the least distance, whatever the norms. Lists hold the rows near a
centroid. Centroids come from a bounded sample that is cut in two, again and again, across the line between the means of
both sides, where the shares of lists to come divide it, so that lists are about even. A row near a border stands in
several lists: those of the next centroids within ``BORDER`` times the least distance, unless a list it stands in is closer
to such a centroid than ``APART`` times the row is (of noise, centroids lie closer to each other than any row to them). Lists are dealt into shards of bounded size, larger ones in pieces.

A query walks a graph of the centroids (each with its nearest ones, its neighbours in the order of the cuts, and a few
far ones), best first, and takes every list within a ratio of the least distance. The ratio is measured: a bounded number
of queries is searched exactly, and the ratio is what reaches ``RECALL`` of their true neighbours. The next lists are added
while a query's hold fewer rows than a result. A shard takes each query once, multiplies it with the lists it asks for in
double precision, and returns the best few.

Equal vectors are one row with their smallest ids, as many as could be in a result. Defined cases: vectors that are null,
empty, zero or hold null or non-finite components and rows without an id take no part; vectors of different lengths never
meet; rows of a query's own id are never its results; repeated rows are rows of their own, a query comes back once for
each of its rows; other columns are ignored; a query without candidates has no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import free, staged

#: Rows that the centroids are fitted on, at most; lists at most; rows of a sample for a list, at least.
SAMPLE, MOST_LISTS, SAMPLE_OF_LIST = 65_536, 4096, 8
#: How much farther than its nearest centroid a further one may be, how far apart a row's lists are, and lists of a row at most.
BORDER, APART, REPLICAS = 1.15, 0.45, 4
#: Queries that the ratio is measured on, and the share of their neighbours that it must reach.
MEASURED, RECALL = 128, 0.97
#: Entries of a shard, and queries that a task takes at once.
SHARD_ROWS, QUERY_ROWS = 16_384, 1024
#: Near, far and least visited centroids of the graph search, and how many it expands at a time.
NEAR, FAR, VISITS, EXPAND = 16, 4, 32, 8


def sound(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def balanced_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """Means of parts of the rows that are as large as each other, but for one row, in the order of the cuts."""
    out, open_parts = [], [(np.arange(len(x)), min(lists, len(x)))]
    while open_parts:
        at, n = open_parts.pop()
        if n == 1:
            out.append(x[at].mean(0))
            continue
        y, left = x[at], len(at) * (n // 2) // n
        p = y[((y - y.mean(0)) ** 2).sum(1).argmax()]
        along = y[((y - p) ** 2).sum(1).argmax()] - p
        for _ in range(4):
            order = np.argsort(y @ along, kind="stable")
            along = y[order[left:]].mean(0) - y[order[:left]].mean(0)
        open_parts += [(at[order[left:]], n - n // 2), (at[order[:left]], n // 2)]
    return np.array(out, np.float32)


def centroid_graph(c: np.ndarray, seed: int = 7) -> np.ndarray:
    """Per centroid: its nearest others, both neighbours in order, and a few drawn ones."""
    n = len(c)
    near = []
    for k in range(0, n, 256):
        d = _squares(c[k : k + 256], c)
        d[np.arange(len(d)), np.arange(k, k + len(d))] = np.inf
        near.append(np.argpartition(d, min(NEAR, n) - 1, axis=1)[:, : min(NEAR, n)])
    ring = np.stack([np.roll(np.arange(n), 1), np.roll(np.arange(n), -1)], 1)
    return np.hstack([np.concatenate(near), ring, np.random.default_rng(seed).integers(0, n, (n, FAR))]).astype(np.int32)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1), 0)


@dataclass(frozen=True)
class Index:
    """Centroids of vectors of one length, their graph, the largest norm, and which lists are searched."""

    radius: float
    centroids: np.ndarray
    graph: np.ndarray
    ratio: float = 1.0
    #: Rows whose nearest centroid is a list's, and how many of them a query's lists hold at least.
    held: np.ndarray | None = None
    least: int = 0

    def rows(self, v: np.ndarray) -> np.ndarray:
        v = v / self.radius
        return np.hstack([v, np.sqrt(np.maximum(1 - (v * v).sum(1, keepdims=True), 0))]).astype(np.float32)

    def queries(self, v: np.ndarray) -> np.ndarray:
        v = v / np.abs(v).max(1, keepdims=True)
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        return np.hstack([v, np.zeros((len(v), 1))]).astype(np.float32)

    def lists_of(self, v: np.ndarray) -> list[np.ndarray]:
        """The lists that each row stands in, its nearest centroid's first."""
        x, c = self.rows(v), self.centroids
        d = _squares(x, c)
        width = min(2 * REPLICAS, len(c))
        near = np.argpartition(d, width - 1, axis=1)[:, :width]
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
        away = np.take_along_axis(d, near, 1)
        kept = np.zeros(near.shape, bool)
        kept[:, 0] = True
        for j in range(1, width):
            ok = (away[:, j] <= BORDER**2 * away[:, 0]) & (kept.sum(1) < REPLICAS)
            for i in range(j):
                ok &= ~kept[:, i] | (((c[near[:, i]] - c[near[:, j]]) ** 2).sum(1) > APART**2 * away[:, j])
            kept[:, j] = ok
        return [n[k] for n, k in zip(near, kept, strict=True)]

    def search(self, v: np.ndarray) -> list[np.ndarray]:
        """The lists within ``ratio`` of the least distance of each query, and more where they hold too few rows, by a walk over the graph."""
        out = []
        for k in range(0, len(v), 256):
            out += self._walk(self.queries(v[k : k + 256]))
        return out

    def _walk(self, q: np.ndarray) -> list[np.ndarray]:
        c, n = self.centroids, len(self.centroids)
        square, every = (c * c).sum(1), np.arange(len(q))
        d, seen, spent = np.full((len(q), n), np.inf, np.float32), np.zeros((len(q), n), bool), np.zeros((len(q), n), bool)
        d[:, 0], seen[:, 0] = _squares(q, c[:1])[:, 0], True
        width, going = min(EXPAND, n), every
        while len(going):
            # a centroid is expanded while it lies within the ratio, or among the nearest few so far
            own = d[going]
            bound = np.maximum(self.ratio**2 * own.min(1), np.partition(own, min(VISITS, n) - 1, axis=1)[:, min(VISITS, n) - 1])
            own[spent[going]] = np.inf
            at = np.argpartition(own, width - 1, axis=1)[:, :width]
            ok = np.isfinite(np.take_along_axis(own, at, 1)) & (np.take_along_axis(own, at, 1) <= bound[:, None])
            row, col = np.nonzero(ok)
            r, e = going[row], at[row, col]
            spent[r, e] = True
            s, t = np.repeat(r, self.graph.shape[1]), self.graph[e].reshape(-1)
            new = ~seen[s, t]
            s, t = np.divmod(np.unique(s[new].astype(np.int64) * n + t[new]), n)
            seen[s, t] = True
            d[s, t] = np.maximum(1 - 2 * np.einsum("ij,ij->i", q[s], c[t]) + square[t], 0)
            going = going[ok.any(1)]
        if self.held is not None:
            poor = np.where(seen, self.held, 0).sum(1) < self.least
            d[poor] = _squares(q[poor], c)
        near = d <= (self.ratio**2 * d.min(1))[:, None] * (1 + 1e-6)
        if self.held is not None:
            order = np.argsort(d, axis=1, kind="stable")
            before = np.cumsum(self.held[order], axis=1) - self.held[order]
            np.put_along_axis(near, order, np.take_along_axis(near, order, 1) | (before < self.least), 1)
        return [np.flatnonzero(x) for x in near]


def _matrix(column) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Places (row, column) of each row's k largest scores, ties at the last place included."""
    if score.shape[1] > k:
        least = np.partition(score, -k, axis=1)[:, -k]
        # matrix products of one pair may differ in the last bits between tiles
        slack = np.where(np.isfinite(least), 1e-9 * np.abs(least), 0)
        return np.stack(np.nonzero(score >= (least - slack)[:, None]))
    return np.stack(np.nonzero(np.ones(score.shape, bool)))


def _trim(a: np.ndarray, b: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, row) once each, as many of a query as ``_best`` keeps."""
    order = np.lexsort((b, a))
    a, b, score = a[order], b[order], score[order]
    one = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    a, b, score = a[one], b[one], score[one]
    order = np.lexsort((-score, a))
    a, b, score = a[order], b[order], score[order]
    first = np.searchsorted(a, a)
    last = score[np.minimum(first + k, np.searchsorted(a, a, side="right")) - 1]
    kept = score >= last - np.where(np.isfinite(last), 1e-9 * np.abs(last), 0)
    return a[kept], b[kept], score[kept]


def fit(nodes: DataFrame) -> Index:
    """An index of vectors of one length (node, v), from a sample of them."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n, radius = nodes.agg(F.count("*"), F.max(norm)).first()
    sample = nodes.where(F.pmod(F.xxhash64("node"), F.lit(n)) < SAMPLE) if n > SAMPLE else nodes
    x = _matrix(sample.limit(SAMPLE).select("v").toArrow().column(0))
    lists = max(1, min(MOST_LISTS, round(n**0.5), len(x) // SAMPLE_OF_LIST))
    bare = Index(radius, np.empty(0), np.empty(0))
    c = balanced_centroids(bare.rows(x), lists)
    return Index(radius, c, centroid_graph(c))


def post(nodes: DataFrame, index: Index) -> DataFrame:
    """Adds ``lists`` to rows with v."""
    kind = nodes.schema.simpleString()[len("struct<") : -1]
    shared = nodes.sparkSession.sparkContext.broadcast(index)  # MOST_LISTS centroids and their links at most

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                lists = []
                v = _matrix(batch.column("v"))
                for k in range(0, len(v), 1024):
                    lists += shared.value.lists_of(v[k : k + 1024])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*batch.schema.names, "lists"])

    return nodes.mapInArrow(run, f"{kind},lists:array<int>")


def measure_ratio(posted: DataFrame, queries: DataFrame, index: Index, k: int) -> float:
    """The ratio within which ``RECALL`` of the k nearest rows of a bounded number of queries are reached; those are searched exactly."""
    asked = queries.orderBy(F.xxhash64("node")).limit(MEASURED).select("node", "v").toArrow()
    if not len(asked):
        return 1.0
    nodes, q = asked.column("node").to_numpy(), _matrix(asked.column("v"))
    shared = posted.sparkSession.sparkContext.broadcast((nodes, q))

    def run(batches):
        own, q = shared.value
        for batch in batches:
            if batch.num_rows:
                score = q @ _matrix(batch.column("v")).T
                score[own[:, None] == batch.column("node").to_numpy()] = -np.inf
                s, t = _best(score, k)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(score[s, t]), batch.column("lists").take(pa.array(t))], names=["q", "score", "lists"])

    found = posted.select("node", "v", "lists").mapInArrow(run, "q long, score double, lists array<int>")
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where((F.col("r") <= k) & (F.col("score") > float("-inf")))
    rows = found.select("q", "lists").collect()  # MEASURED times k at most
    away = np.sqrt(_squares(index.queries(q), index.centroids))
    need = sorted(away[r["q"], r["lists"]].min() / max(away[r["q"]].min(), 1e-12) for r in rows)
    return float(need[min(len(need) - 1, int(np.ceil(RECALL * len(need))))]) if need else 1.0


def shards(sizes: dict[int, int], lists: int) -> tuple[np.ndarray, np.ndarray]:
    """Per list its first shard and how many shards its entries are spread over: neighbouring lists together up to SHARD_ROWS."""
    first, pieces, shard, filled = np.zeros(lists, np.int64), np.ones(lists, np.int64), 0, 0
    for k in range(lists):
        n = sizes.get(k, 0)
        if filled and filled + n > SHARD_ROWS:
            shard, filled = shard + 1, 0
        first[k], pieces[k] = shard, max(1, -(-n // SHARD_ROWS))
        shard, filled = (shard + int(pieces[k]), 0) if pieces[k] > 1 else (shard, filled + n)
    return first, pieces


def _search_length(posted: DataFrame, queries: DataFrame, index: Index, k: int) -> DataFrame:
    """(query: node, score, ids) of at least the k best rows that each query finds in each shard."""
    spark = posted.sparkSession
    counts = posted.select(F.posexplode("lists").alias("place", "list")).groupBy("list").agg(F.count("*").alias("n"), F.count_if(F.col("place") == 0).alias("held")).collect()  # a row a list
    first, pieces = shards({r["list"]: r["n"] for r in counts}, len(index.centroids))
    held = np.zeros(len(index.centroids), np.int64)
    held[[r["list"] for r in counts]] = [r["held"] for r in counts]
    index = replace(index, held=held, least=k)
    place = spark.createDataFrame(list(zip(range(len(first)), first.tolist(), pieces.tolist(), strict=True)), "list int, first long, pieces long")
    shared = spark.sparkContext.broadcast(index)
    kind = posted.schema["v"].dataType.simpleString()

    def route(batches):
        for batch in batches:
            if batch.num_rows:
                lists = shared.value.search(_matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([*batch.select(["node", "v"]).columns, pa.array(lists, pa.list_(pa.int32()))], names=["node", "v", "lists"])

    asked = queries.select("node", "v").mapInArrow(route, f"node long, v {kind}, lists array<int>")
    # a query goes to a shard once, with the lists that it asks for there
    at = asked.select("node", F.explode("lists").alias("list")).join(F.broadcast(place), "list").select("node", "list", F.explode(F.sequence("first", F.col("first") + F.col("pieces") - 1)).alias("shard"))
    at = at.groupBy("node", "shard").agg(F.collect_list("list").alias("lists"))
    asked = staged(at.join(queries.select("node", "v"), "node"), "ann-asked")
    blocks = asked.groupBy("shard").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("blocks"))
    entries = posted.select("node", "ids", "v", F.explode("lists").alias("list")).join(F.broadcast(place), "list")
    entries = entries.withColumn("shard", F.col("first") + F.pmod(F.xxhash64("node"), F.col("pieces")))
    # a vector stands in a shard once for all its lists there
    entries = entries.groupBy("shard", "node").agg(F.first("ids").alias("ids"), F.first("v").alias("v"), F.collect_list("list").alias("lists"))
    entries = entries.join(blocks, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "node", "ids", "v", "lists")
    mine = asked.join(blocks, "shard").select("shard", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"), "node", F.lit(None).cast("array<long>").alias("ids"), "v", "lists")

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("ids").combine_chunks()
        is_row = ids.is_valid().to_numpy(zero_copy_only=False)
        nodes, v = table.column("node").to_numpy(), _matrix(table.column("v"))
        lists = table.column("lists").to_pylist()
        rows, qs = np.flatnonzero(is_row), np.flatnonzero(~is_row)
        stands, asks = ({}, {})
        for of, some in ((stands, rows), (asks, qs)):
            for r in some:
                for x in lists[r]:
                    of.setdefault(x, []).append(r)
        a = b = np.empty(0, np.int64)
        score = np.empty(0)
        for x in asks.keys() & stands.keys():
            of, to = np.array(asks[x]), np.array(stands[x])
            product = v[of] @ v[to].T
            s, t = _best(product, k)
            a, b, score = _trim(np.append(a, of[s]), np.append(b, to[t]), np.append(score, product[s, t]), k)
        for at in range(0, len(a), 65_536):
            part = slice(at, at + 65_536)
            score[part] = np.einsum("ij,ij->i", v[a[part]], v[b[part]])
        least = pa.compute.list_element(ids.take(pa.array(rows)), 0).to_numpy() if len(rows) else np.empty(0, np.int64)
        small = np.zeros(len(nodes), np.int64)
        small[rows] = least
        order = np.lexsort((small[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        kept = np.arange(len(a)) - np.searchsorted(a, a) < k
        a, b, score = a[kept], b[kept], score[kept]
        return pa.table({"query": pa.array(nodes[a]), "node": pa.array(nodes[b]), "score": pa.array(score), "ids": ids.take(pa.array(b))})

    return entries.unionByName(mine).groupBy("shard", "block").applyInArrow(run, "query long, node long, score double, ids array<long>")


def nearest(table: DataFrame, is_query: str = "id % 20 = 0", k: int = 20) -> DataFrame:
    """Rows (id, v: array of numbers) to query_id, rank (from 1), id, score: each query's k nearest found among all other rows."""
    kind = "float" if table.schema["v"].dataType.simpleString() == "array<float>" else "double"
    v = F.col("v").cast(f"array<{kind}>")
    rows = table.select(F.col("id").cast("long").alias("id"), F.transform(v, lambda x: x + F.lit(0).cast(kind)).alias("v")).where(F.col("id").isNotNull() & sound(F.col("v")))
    # vectors that are equal in all components share two 64-bit hashes; k + 1 ids of them could be in a result, the query's own being one
    keyed = rows.withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(9), "v"))
    first = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))
    nodes = keyed.withColumn("r", first).where(F.col("r") <= k + 1).groupBy("k1", "k2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v"))
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "ann-nodes")
    queries = keyed.where(is_query).select("id", "k1", "k2")
    asked = staged(nodes.join(queries.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("node", "v"), "ann-queries")
    found, lists = [], []
    for (dim,) in nodes.groupBy(F.size("v").alias("dim")).count().select("dim").orderBy("dim").collect():
        of = F.size("v") == dim
        index = fit(nodes.where(of))
        posted = staged(post(nodes.where(of).select("node", "ids", "v"), index), "ann-lists")
        # a vector's own place doesn't count towards the k
        index = replace(index, ratio=measure_ratio(posted, asked.where(of), index, k))
        part = _search_length(posted, asked.where(of), index, k + 1)
        # a row is found in REPLICAS shards at most
        near = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0]))
        part = part.withColumn("r", near).where(F.col("r") <= REPLICAS * (k + 1)).drop("r")
        found.append(staged(part, "ann-found"))
        lists.append(posted)
    if not found:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    best = found[0]
    for x in found[1:]:
        best = best.unionByName(x)
    each = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("away"), i.alias("id")))
    best = best.dropDuplicates(["query", "node"]).groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list(each))), 1, (k + 1) ** 2).alias("near"))
    # a vector that many queries share: the side with a row a query is split by Spark
    out = queries.join(nodes.select("k1", "k2", F.col("node").alias("query")), ["k1", "k2"]).join(best, "query")
    out = out.select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)).alias("place", "x"))
    out = staged(out.select("query_id", (F.col("place") + 1).alias("rank"), F.col("x.id").alias("id"), (-F.col("x.away")).alias("score")), "ann")
    free(nodes, asked, *found, *lists)
    return out
