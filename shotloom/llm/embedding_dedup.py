"""All pairs of vectors of high cosine by a subspace pigeonhole join, and their connected components.

Unit vectors x, y of cosine c have squared distance 2 - 2c, which any orthogonal rotation keeps. If the rotated vectors
are split into blocks, the blocks' squared distances sum to it, so one block at least has no more than its share, in
proportion to its width. Each block is range-joined under that budget: along the block's first coordinate vectors lie in
strips of some ``CHUNK`` each, and two strips meet in one task, with those of their vectors that are within reach of the
other; there, coordinate by coordinate, vectors are cut into pieces that meet what is within reach of them, block distances
beyond the budget drop out by one matrix product, and what is left is verified on the whole vectors in double precision. A
pair counts in the first block that has it within budget, so the union over blocks needs no pass over pairs, and a task
returns a row per vector: its number of links and the smallest vector that it reaches there.

Vectors travel packed, those of a batch that go to one task in a row, a row ``PACKED`` of them at most; a vector is copied
once a block as long as a block is one strip, and once for each strip within its reach beyond. A task holds two strips at
most, whatever the size of the table. Identical vectors are one row with a multiplicity before the join. Strips are cut at
quantiles of a sample, which only says how even they are.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are kept;
vectors of different lengths never link; a null ``vec_id`` takes no part in links and returns as its own row; rows of one
id with other vectors are vectors of their own that share an id, each with its own links; components of floats and of
doubles are taken as they are; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import staged

THRESHOLD = 0.95
BLOCK_WIDTH = 8
#: Vectors of a strip, about; those that strips are cut by, for each strip; vectors of a packed row.
CHUNK, SAMPLED, PACKED = 1 << 17, 256, 1 << 11
#: Pieces of a coordinate, members of a piece that is not cut further, and rows that it meets at once.
PIECES, LEAF, TILE = 8, 64, 4096
#: Pairs that are verified at once.
PAIRS = 1 << 14
_SLACK = 1e-6


def rotation(n: int, seed: int = 11) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))
    return q * np.sign(np.diag(r))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def budgets(n: int, threshold: float, width: int = BLOCK_WIDTH) -> tuple[list[slice], np.ndarray]:
    """The blocks of an n-dimensional vector and each block's squared-distance budget."""
    blocks = [slice(k, min(n, k + width)) for k in range(0, n, width)]
    return blocks, np.array([(2 - 2 * threshold) * (b.stop - b.start) / n for b in blocks])


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def strips(vectors: DataFrame, chunk: int) -> dict[int, list[np.ndarray]]:
    """Per length of vectors and block, where the block's first coordinate is cut into strips of some ``chunk`` vectors; none where one will do."""
    size = F.size("v").alias("size")
    many = {r["size"]: -(-r["count"] // chunk) for r in vectors.groupBy(size).count().collect()}
    cuts = {}
    for length, parts in many.items():
        if parts > 1:
            found = vectors.where(F.size("v") == length).select("node", "v").orderBy(F.xxhash64("node")).limit(SAMPLED * parts).toArrow()
            first = _unit(_vectors(found.column("v"))) @ rotation(length)[:, ::BLOCK_WIDTH]
            cuts[length] = list(np.quantile(first, np.arange(1, parts) / parts, axis=0).T)
    return cuts


def meetings(first: np.ndarray, cuts: np.ndarray, reach: float):
    """(p, q, rows): which rows take part where strips p and q meet, p <= q, by the coordinate that strips are cut along."""
    strip = np.searchsorted(cuts, first, side="right")
    lowest, highest = np.searchsorted(cuts, first - reach, side="left"), np.searchsorted(cuts, first + reach, side="right")
    for s in range(len(cuts) + 1):
        own = np.flatnonzero(strip == s)
        if len(own):
            for t in range(lowest[own].min(), highest[own].max() + 1):
                yield min(s, t), max(s, t), own[(lowest[own] <= t) & (t <= highest[own])]


def _pieces(y: np.ndarray, some: np.ndarray, others: np.ndarray, reach: float, coordinate: int = 0):
    """(rows of some, rows of others) so that all pairs whose coordinates are all within reach are in just one of them."""
    n = min(PIECES, -(-len(some) // LEAF))
    if n <= 1 or coordinate == y.shape[1]:
        yield some, others
        return
    some, others = (z[np.argsort(y[z, coordinate], kind="stable")] for z in (some, others))
    place = y[others, coordinate]
    for piece in np.array_split(some, n):
        low, high = np.searchsorted(place, y[piece[0], coordinate] - reach, side="left"), np.searchsorted(place, y[piece[-1], coordinate] + reach, side="right")
        if high > low:
            yield from _pieces(y, piece, others[low:high], reach, coordinate + 1)


def _near(y: np.ndarray, some: np.ndarray, others: np.ndarray, reach: float, most: float):
    """Pairs (some, other) of rows of y whose distance is within the budget, with some that are not, tile by tile."""
    square = (y * y).sum(1, keepdims=True)
    one = np.ones_like(square)
    left, right = np.hstack([-2 * y, square, one]), np.hstack([y, one, square])
    for a, b in _pieces(y, some, others, reach):
        for i in range(0, len(a), 4 * LEAF):
            s = a[i : i + 4 * LEAF]
            own = left[s]
            for j in range(0, len(b), TILE):
                t = b[j : j + TILE]
                hit = np.flatnonzero((own @ right[t].T).reshape(-1) <= most)
                if len(hit):
                    k, m = np.divmod(hit, len(t))
                    yield s[k], t[m]


def _root(root: np.ndarray, x: np.ndarray) -> np.ndarray:
    while ((to := root[x]) != x).any():
        x = to
    return x


def _unite(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the trees of u and v pair by pair; the smaller root stays one."""
    while len(u):
        a, b = _root(root, u), _root(root, v)
        root[u], root[v] = a, b
        low, high, apart = np.minimum(a, b), np.maximum(a, b), a != b
        np.minimum.at(root, high[apart], low[apart])
        u, v = u[apart], v[apart]


def links(vectors: DataFrame, threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """vectors (node, n, v: array), distinct and valid, to rows (node, root, n_links); some nodes in several rows."""
    cuts = strips(vectors, chunk)
    kinds = ["size", "block", "p", "q", "node", "n", "high", "v"]
    rows_of = lambda out: pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if c in kinds[:4] else pa.binary()) for c, x in zip(kinds, zip(*out, strict=True), strict=True)], names=kinds)
    kind = np.float32 if vectors.schema["v"].dataType.simpleString() == "array<float>" else np.float64

    def packed(batches):
        """A row per length, block and two strips that meet, and the batch's rows that take part, as bytes."""
        for batch in batches:
            for size in set(batch.column("size").to_pylist()):
                own = batch.filter(pc.equal(batch.column("size"), size))
                raw = own.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                node, n = (own.column(c).to_numpy() for c in ("node", "n"))
                blocks, most = budgets(size, threshold)
                first = _unit(raw.astype(np.float64)) @ rotation(size)[:, ::BLOCK_WIDTH]
                for k, m in enumerate(most):
                    cut = cuts[size][k] if size in cuts else np.empty(0)
                    out = []
                    for p, q, at in meetings(first[:, k], cut, np.sqrt(m) * (1 + _SLACK) + _SLACK):
                        strip = (np.searchsorted(cut, first[at, k], side="right") == q).astype(np.int8)
                        out += [(size, k, p, q, *(z.tobytes() for z in (node[rows], n[rows], high, raw[rows]))) for i in range(0, len(at), PACKED) for rows, high in [(at[i : i + PACKED], strip[i : i + PACKED])]]
                        if sum(len(x[-1]) for x in out) > 1 << 24:
                            yield rows_of(out)
                            out = []
                    if out:
                        yield rows_of(out)

    def join(table: pa.Table) -> pa.Table:
        size, k, p, q = (table.column(c)[0].as_py() for c in ("size", "block", "p", "q"))
        nodes, weight, high, raw = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(c)]) for c, t in (("node", np.int64), ("n", np.int64), ("high", np.int8), ("v", kind)))
        del table
        raw = raw.reshape(-1, size)
        blocks, most = budgets(size, threshold)
        turn = rotation(size)
        y, biggest, norm = np.empty((len(raw), blocks[k].stop - blocks[k].start), np.float32), np.empty(len(raw)), np.empty(len(raw))
        for i in range(0, len(raw), TILE):
            x = raw[i : i + TILE].astype(np.float64)
            biggest[i : i + TILE] = np.abs(x).max(1)
            x /= biggest[i : i + TILE, None]
            norm[i : i + TILE] = np.linalg.norm(x, axis=1)
            y[i : i + TILE] = (x / norm[i : i + TILE, None]) @ turn[:, blocks[k]]
        unit = lambda u: raw[u].astype(np.float64) / biggest[u, None] / norm[u, None]
        every = np.arange(len(nodes))
        count, root, order, place = np.zeros(len(nodes), np.int64), every.copy(), np.argsort(nodes, kind="stable"), every.copy()
        place[order] = every  # smaller places are smaller nodes
        some, others = (every, every) if p == q else (every[high == 0], every[high == 1])
        for s, t in _near(y, some, others, np.float32(np.sqrt(most[k]) + 1e-5), most[k] + 1e-5):
            if p == q:  # both are members of the strip: they meet once
                s, t = s[s < t], t[s < t]
            for at in range(0, len(s), PAIRS):
                u, v = s[at : at + PAIRS], t[at : at + PAIRS]
                a, b = unit(u), unit(v)
                ok = np.einsum("ij,ij->i", a, b) >= threshold
                if not ok.any():
                    continue
                u, v, d = u[ok], v[ok], ((a[ok] - b[ok]) @ turn) ** 2
                within = np.stack([d[:, z].sum(1) for z in blocks], 1) <= most * (1 + _SLACK) + 1e-12
                ok = within.argmax(1) == k
                u, v = u[ok], v[ok]
                np.add.at(count, u, weight[v])
                np.add.at(count, v, weight[u])
                _unite(root, place[u], place[v])
        root = _root(root, place)
        some = count > 0
        return pa.table({"node": pa.array(nodes[some]), "root": pa.array(nodes[order[root[some]]]), "n_links": pa.array(count[some])})

    kept = vectors.select("node", "n", F.size("v").alias("size"), "v")
    rows = kept.mapInArrow(packed, "size int, block int, p int, q int, node binary, n binary, high binary, v binary")
    return rows.groupBy("size", "block", "p", "q").applyInArrow(join, "node long, root long, n_links long")


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per vector: its id, ``n_links``, ``component_id`` and ``kept``."""
    kind = "float" if table.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    v = F.col(vector_col).cast(f"array<{kind}>")
    sound = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.when(sound & F.col(id_col).isNotNull(), F.transform(v, lambda x: x + F.lit(0).cast(kind))).alias("v"))
    # vectors that are equal in all components share two 64-bit hashes
    keyed = rows.withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(9), "v"))
    distinct = keyed.where("v IS NOT NULL").groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v"))
    distinct = staged(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    found = staged(links(distinct, threshold), "vector-links")
    counts = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "vector-components")
    known = distinct.select("k1", "k2", "node", "id", "n").join(counts, "node", "left").join(parts, "node", "left")
    known = known.withColumn("component", F.coalesce("component", "node"))
    least = known.groupBy("component").agg(F.min("id").alias("component_id"))
    known = known.join(least, "component").select("k1", "k2", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id")
    # copies of one vector may be a third of all rows: the side with a row per vector meets them in parts that Spark splits
    out = keyed.select("vec_id", F.when(F.col("v").isNotNull(), F.col("k1")).alias("k1"), "k2").join(known, ["k1", "k2"], "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
