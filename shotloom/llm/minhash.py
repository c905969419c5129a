"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification.

A document is its set of five-word shingles (the words of a shorter one are a single shingle), weighted by how often each
occurs. ProbMinHash lets every shingle arrive at registers by a Poisson process of its weight as rate; a register keeps
its first arrival, and a shingle stops as soon as its next arrival is later than all registers. Two documents agree in a
register with the probability Jaccard similarity of their weights. Registers are banded into buckets, and candidate pairs
are verified by that same similarity, computed exactly, ``THRESHOLD`` or more. Where no shingle repeats within a text, it
is the Jaccard similarity of the shingle sets.

Nodes are texts, not ids: texts that are equal in their words (by a 128-bit hash) are one node from the start, so that
copies cost one row. Classes are the components of the links between nodes, found in rounds that are linear in the
buckets' members:

1. In each bucket a hub, the member with most bucket mates, meets all others; a node's best hub by the signatures is
   verified first, its other hubs if they are in other components then.
2. In buckets that still hold several components, members outside the largest one meet all members of other components
   inside tasks, in chunks, without a row per pair; a pair is verified in the first bucket that it shares.

Pairs whose signatures agree in fewer than ``least_agreement`` registers are not verified: at the threshold a pair is so
far below its expectation once in some 10^11 pairs. No bucket is capped, and texts are never brought together: a scan
makes signatures, and only the shingle hashes of nodes that share a bucket are looked at again.

Defined cases: null, empty and blank texts have no shingles: each is a class of its own and is kept; a row with a null
``doc_id`` takes no part and is kept; rows of one doc_id with other texts are documents of their own that share an id, and
each is kept or not by its own text; repeated rows of one id and text are marked alike, and ``keep_one`` leaves one of
them; other columns are carried by ``keep_one`` whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .storage import free, staged
from .tokens import forget_all
from .words import Words, batched, mix, shingle_hashes, words_of

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 26, 5
#: Members of a bucket, and bytes of their shingles, that one task compares with as many others.
CHUNK, CHUNK_BYTES = 4096, 64 << 20
#: Pairs that are verified beside one copy of their hub's shingles.
HUB_PAIRS = 512
_KEY = "k1 long, k2 long"


def weighted_sets(words: Words, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, number of times) of all texts, by text and hash."""
    doc, own = shingle_hashes(words, width)
    order = np.argsort(own)
    small = doc[order].astype(np.uint16) if words.n_docs <= 1 << 16 else doc[order]
    order = order[np.argsort(small, kind="stable")]
    doc, own = doc[order], own[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])])) if len(doc) else np.zeros(0, np.int64)
    return doc[first], own[first], np.diff(np.concatenate([first, [len(doc)]]))


def text_keys(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, k1, k2) of the texts that have words: hashes of their words in order."""
    if not len(words.doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], words.doc[1:] != words.doc[:-1]]))
    place = np.arange(len(words.doc)) - np.repeat(first, np.diff(np.concatenate([first, [len(words.doc)]])))
    h = mix(words.hash + place.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    k1 = np.add.reduceat(h, first)
    k2 = np.add.reduceat((h ^ (h >> np.uint64(29))) * np.uint64(0xE7037ED1A0B428DB), first)
    return words.doc[first], k1.view(np.int64), k2.view(np.int64)


def signatures(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n_docs: int, size: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash signatures of weighted sets: per document and register the item that arrives first (0: none)."""
    time, who = np.full(n_docs * size, np.inf), np.zeros(n_docs * size, np.uint64)
    rate = 1.0 / weight
    # few items need many arrivals each before all registers are taken: they are drawn in blocks
    count = np.bincount(doc, minlength=n_docs)
    block = np.clip(np.ceil(1.3 * size * np.log(size + 1) / np.maximum(count, 1)), 1, 4 * size).astype(np.int64)
    live, clock, drawn = np.arange(len(doc)), np.zeros(len(doc)), np.zeros(len(doc), np.int64)
    while len(live):
        n = block[doc[live]]
        at = np.repeat(np.arange(len(live)), n)
        k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + drawn[live][at]
        h = mix(item[live][at] + k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        gap = -np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * rate[live][at]
        arrival = np.cumsum(gap)
        ends = np.cumsum(n)
        before = np.concatenate([[0.0], arrival[ends[:-1] - 1]])
        arrival += (clock[live] - before)[at]
        register = doc[live][at] * size + (mix(h ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(size)).astype(np.int64)
        # the earliest of the new arrivals of each register, ties by item
        early = arrival < time[register]
        register, new, own = register[early], arrival[early], item[live][at][early]
        order = np.lexsort((own, new, register))
        register, new, own = register[order], new[order], own[order]
        first = np.flatnonzero(np.concatenate([[True], register[1:] != register[:-1]])) if len(register) else np.zeros(0, np.int64)
        time[register[first]], who[register[first]] = new[first], own[first]
        clock[live] = arrival[ends - 1]
        drawn[live] += n
        latest = time.reshape(n_docs, size).max(1)
        live = live[clock[live] < latest[doc[live]]]
    return who.reshape(n_docs, size)


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A bucket number for each band of each signature."""
    out = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        own = np.full(len(signature), b + 1, np.uint64)
        for r in range(rows):
            own = mix(own * np.uint64(0x2545F4914F6CDD1D) + signature[:, b * rows + r])
        out[:, b] = own
    return out.view(np.int64)


def least_agreement(registers: int, threshold: float) -> int:
    """Registers in which a pair at the threshold agrees but for odds of some 10^-11: seven deviations below the mean."""
    return max(1, math.floor(registers * threshold - 7 * math.sqrt(registers * threshold * (1 - threshold))))


def _texts(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[tuple[slice, Words]]:
    raw = [(t or "").encode() for t in batch.column(column).to_pylist()]
    for part in batched(raw, most):
        yield part, words_of(raw[part])


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs (doc_id, text) to (doc_id, k1, k2, buckets, marks); all but doc_id are null where there are no words or no id.

    ``marks`` is a byte of each register's item.
    """
    size = bands * rows

    def run(batches):
        forget_all()
        for batch in batches:
            for part, words in _texts(batch, "text"):
                ids = batch.column("doc_id").slice(part.start, part.stop - part.start)
                at, k1, k2 = text_keys(words)
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                doc, item, weight = weighted_sets(words)
                place = np.full(len(ids), -1)
                place[at] = np.arange(len(at))
                who = signatures(place[doc], item, weight, len(at), size) if len(at) else np.zeros((0, size), np.uint64)
                keep = known[at]
                at, k1, k2, who = at[keep], k1[keep], k2[keep], who[keep]
                where = np.full(len(ids), -1)
                where[at] = np.arange(len(at))
                take = pa.array(np.maximum(where, 0), mask=where < 0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * bands, pa.int32()), pa.array(band_hashes(who, bands, rows).reshape(-1)))
                # the low byte of a scramble, as shingle hashes of one band agree in full anyway
                marks = pa.array([m.tobytes() for m in (mix(who) & np.uint64(255)).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, *[x.take(take) for x in (pa.array(k1), pa.array(k2), lists, marks)]], names=["doc_id", "k1", "k2", "buckets", "marks"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {_KEY}, buckets array<long>, marks binary")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """rows (node, k1, k2, text) to (node, size, items, weights) where the text has that key: sorted shingle hashes as
    64-bit and their counts as 32-bit integers; weights are empty where all are one. A task returns a node once; others
    may return it too, if rows are repeated."""

    def run(batches):
        forget_all()
        seen: set[int] = set()
        for batch in batches:
            nodes, k1, k2 = (batch.column(c).to_numpy() for c in ("node", "k1", "k2"))
            for part, words in _texts(batch, "text"):
                at, h1, h2 = text_keys(words)
                same = (k1[part][at] == h1) & (k2[part][at] == h2)
                for k, x in enumerate(nodes[part][at].tolist()):
                    same[k] &= x not in seen
                    if same[k]:
                        seen.add(x)
                doc, item, weight = weighted_sets(words)
                ends = np.searchsorted(doc, at[same], side="right")
                begun = np.searchsorted(doc, at[same])
                items = [item[i:j].tobytes() for i, j in zip(begun, ends, strict=True)]
                weights = [b"" if (w := weight[i:j]).max() == 1 else w.astype("<u4").tobytes() for i, j in zip(begun, ends, strict=True)]
                sizes = pa.array([len(x) + len(y) for x, y in zip(items, weights, strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(nodes[part][at[same]]), sizes, pa.array(items, pa.binary()), pa.array(weights, pa.binary())], names=["node", "size", "items", "weights"])

    return rows.select("node", "k1", "k2", "text").mapInArrow(run, "node long, size long, items binary, weights binary")


Shingles = tuple[np.ndarray, np.ndarray | None]


def _set(items: bytes, weights: bytes) -> Shingles:
    return np.frombuffer(items, np.uint64), np.frombuffer(weights, "<u4").astype(float) if weights else None


def similarity(a: Shingles, b: Shingles) -> float:
    """Probability Jaccard similarity of two weighted sets: sorted distinct hashes and their weights (None: all one).

    The sum over common items i of 1 / sum over all items j of max(x_j / x_i, y_j / y_i); for weights of one, the share of
    common items among all.
    """
    (p, x), (q, y) = a, b
    if not len(p) or not len(q):
        return 0.0
    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
    both = q[at] == p
    n = int(both.sum())
    if x is None and y is None:
        return n / (len(p) + len(q) - n)
    x, y = np.ones(len(p)) if x is None else x, np.ones(len(q)) if y is None else y
    cx, cy = x[both], y[at[both]]
    order = np.argsort(cx / cy)
    cx, cy = cx[order], cy[order]
    # items of a larger ratio x/y, and those of a alone, count by x, the others by y
    by_x = x.sum() - np.cumsum(cx)
    by_y = y.sum() - cy.sum() + np.cumsum(cy)
    return float((1 / (by_x / cx + by_y / cy)).sum())


def verified(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold; a is the side that many pairs may share.

    b's shingles go to the pair, a's to every ``HUB_PAIRS`` of its pairs, where they are read first.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_PAIRS).alias("parts"))
    heads = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"))
    tails = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
    rows = heads.unionByName(tails).withColumn("node", F.coalesce("b", "a")).join(sets, "node").select("a", "part", "b", "items", "weights")

    def run(batches):
        at, head = None, None
        for batch in batches:
            a, part, b = (batch.column(c).to_pylist() for c in ("a", "part", "b"))
            out = np.zeros(batch.num_rows, bool)
            for k, (items, weights) in enumerate(zip(batch.column("items"), batch.column("weights"), strict=True)):
                own = _set(items.as_buffer(), weights.as_buffer() if len(weights.as_buffer()) else b"")
                if b[k] is None:
                    at, head = (a[k], part[k]), (own[0].copy(), own[1])
                elif at == (a[k], part[k]):
                    out[k] = similarity(head, own) >= threshold - 1e-12
            yield batch.select(["a", "b"]).filter(pa.array(out))

    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").isNotNull())
    return rows.mapInArrow(run, "a long, b long")


def _marks(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def agreeing(pairs: DataFrame, marks: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose marks agree ``least`` times, and how often they do."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n = (_marks(batch.column("x")) == _marks(batch.column("y"))).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(n.astype(np.int32))], names=["a", "b", "n"]).filter(pa.array(n >= least))

    one, two = marks.toDF("a", "x"), marks.toDF("b", "y")
    return pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, n int")


def _reaching(head: Shingles, others: list[Shingles], threshold: float) -> np.ndarray:
    """Which of the sets reach the threshold with the head's: those without weights all at once."""
    out = np.zeros(len(others), bool)
    even = [k for k, x in enumerate(others) if head[1] is None and x[1] is None]
    if even:
        size = np.array([len(others[k][0]) for k in even])
        flat = np.concatenate([others[k][0] for k in even])
        both = head[0][np.minimum(np.searchsorted(head[0], flat), len(head[0]) - 1)] == flat
        n = np.add.reduceat(both, np.cumsum(size) - size, dtype=np.int64)
        out[even] = n >= (threshold - 1e-12) * (size + len(head[0]) - n)
    for k in set(range(len(others))).difference(even):
        out[k] = similarity(head, others[k]) >= threshold - 1e-12
    return out


def leftovers(labelled: DataFrame, texts: DataFrame, sets: DataFrame, least: int, threshold: float, chunk: int) -> DataFrame:
    """Links (a, b) between unlike components of buckets that hold several: labelled (bucket, node, label).

    Members outside the bucket's largest component meet all its members. A bucket of more than ``chunk`` members, or more
    than ``CHUNK_BYTES``, is cut into chunks that meet each other.
    """
    rows = labelled.join(sets.select("node", "size").dropDuplicates(["node"]), "node")
    sizes = rows.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    major = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("minor"), F.sum("size").alias("size")).where("minor > 0")
    cuts = F.ceil(F.col("size") / CHUNK_BYTES)
    major = major.select("bucket", "major", F.greatest(F.ceil(F.col("n") / chunk), cuts).alias("p"), F.greatest(F.ceil(F.col("minor") / chunk), F.ceil(cuts * F.col("minor") / F.col("n"))).alias("q"))
    rows = labelled.join(major, "bucket")
    rows = rows.withColumns({"side": F.col("label") != F.col("major"), "own_p": F.pmod(F.xxhash64("node", F.lit(3)), F.col("p")), "own_q": F.pmod(F.xxhash64("node", F.lit(4)), F.col("q"))})
    places = F.expr("""concat(
        transform(sequence(0L, q - 1), k -> struct(own_p AS p0, k AS q0, true AS member, side AND k = own_q AS head)),
        transform(filter(sequence(0L, p - 1), k -> side AND k <> own_p), k -> struct(k AS p0, own_q AS q0, false AS member, true AS head)))""")
    dealt = rows.select("bucket", "node", "label", F.inline(places)).join(texts.select("node", "buckets", "marks"), "node").join(sets.drop("size"), "node")

    def meet(table: pa.Table) -> pa.Table:
        bucket, node = table.column("bucket")[0].as_py(), table.column("node").to_numpy()
        group = {x: x for x in table.column("label").to_pylist()}
        label = np.array(table.column("label").to_pylist())
        own, bands = _marks(table.column("marks")), np.array(table.column("buckets").to_pylist(), np.int64)
        items = [_set(x, w) for x, w in zip(table.column("items").to_pylist(), table.column("weights").to_pylist(), strict=True)]
        members, heads = (np.flatnonzero(table.column(c).to_numpy()) for c in ("member", "head"))

        def find(x):
            while group[x] != x:
                x = group[x]
            return x

        out = []
        for i in heads.tolist():
            n = (own[i] == own[members]).sum(1, dtype=np.int32)
            some = members[(n >= least) & (label[members] != label[i])]
            same = bands[i] == bands[some]
            some = some[bands[i][same.argmax(1)] == bucket] if len(some) else some
            for at in range(0, len(some), 256):
                part = [j for j in some[at : at + 256].tolist() if find(label[j]) != find(label[i])]
                hit = _reaching(items[i], [items[j] for j in part], threshold) if part else []
                for j in (j for j, x in zip(part, hit, strict=True) if x):
                    if find(label[j]) != find(label[i]):
                        group[find(label[j])] = find(label[i])
                        out.append((max(node[i], node[j]), min(node[i], node[j])))
        return pa.table({c: pa.array([x[k] for x in out], pa.int64()) for k, c in enumerate("ab")})

    return dealt.groupBy("bucket", "p0", "q0").applyInArrow(meet, "a long, b long")


def _unlike(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are in different components."""
    one, two = parts.toDF("a", "la"), parts.toDF("b", "lb")
    return pairs.join(one, "a", "left").join(two, "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def _rows(docs: DataFrame, threshold: float, bands: int, rows: int, chunk: int) -> DataFrame:
    """Per row of docs: doc_id, k1, k2, class_id and kept."""
    least = least_agreement(bands * rows, threshold)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = staged(sketch(base, bands, rows), "near-sketches")
    texts = keyed.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("buckets").alias("buckets"), F.first("marks").alias("marks"))
    texts = staged(texts.withColumn("node", F.monotonically_increasing_id()), "near-texts")
    marks = texts.select("node", "marks")
    placed = texts.select("node", F.explode("buckets").alias("bucket"))
    several = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = staged(placed.join(several, "bucket"), "near-shared")
    mates = shared.groupBy("node").agg(F.sum("n").alias("mates"))
    hubs = shared.join(mates, "node").groupBy("bucket").agg(F.max_by("node", F.struct("mates", "node")).alias("hub"))
    stars = shared.join(hubs, "bucket").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    stars = staged(agreeing(stars, marks, least), "near-stars")
    # whole texts are read again for the nodes that have bucket mates only
    asked = shared.select("node").distinct().join(texts.select("node", "doc_id", "k1", "k2"), "node")
    sets = staged(shingle_sets(base.join(asked, "doc_id")), "near-sets")
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b")
    links = staged(verified(best, sets, threshold), "near-links")
    parts = connected_components(links, "near-parts")
    for rest in (True, False):
        if rest:
            found = verified(_unlike(stars.select("a", "b"), parts), sets, threshold)
        else:  # a bucket of two is done by its hub
            labelled = shared.where("n > 2").join(parts, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("label"))
            found = leftovers(labelled, texts, sets, least, threshold, chunk)
        last = links, parts
        links = staged(links.unionByName(found), "near-links")
        parts = connected_components(links, "near-parts")
        free(*last)
    own = texts.select("node", "doc_id", "k1", "k2")
    members = own.join(parts, "node")
    chosen = members.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("x")).select("component", F.col("x.doc_id").alias("class_id"), F.col("x.node").alias("stays"))
    members = members.join(chosen, "component").select("node", "class_id", "stays")
    classes = own.join(members, "node", "left").select("k1", "k2", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(F.col("stays") == F.col("node"), F.lit(True)).alias("stays"))
    out = keyed.select("doc_id", "k1", "k2").join(classes, ["k1", "k2"], "left")
    out = out.select("doc_id", "k1", "k2", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(F.col("stays") & (F.col("doc_id") == F.col("class_id")), F.lit(True)).alias("kept"))
    out = staged(out, "near-rows")
    free(keyed, texts, shared, stars, sets, parts, links)
    return out


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, chunk: int = CHUNK) -> DataFrame:
    """Per document: doc_id, class_id (the smallest doc_id of its class) and ``kept`` (one document of each class)."""
    return _rows(docs, threshold, bands, rows, chunk).select("doc_id", "class_id", "kept")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, chunk: int = CHUNK) -> DataFrame:
    """The documents with all their columns, one of each class; of repeated rows of one id and text one stays."""
    found = _rows(docs, threshold, bands, rows, chunk)
    ids = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("kept").alias("n_kept"))
    ids = staged(ids.where("n_kept = 0 OR n > 1"), "near-ids")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = whole.join(ids.select("doc_id"), "doc_id", "left_anti").select("row.*")
    again = ids.where("n_kept > 0")
    if again.isEmpty():
        return out
    # ids of several rows: each row is looked up by its own text
    mine = whole.join(again.select("doc_id"), "doc_id", "left_semi").withColumn("text", F.col("row.text").cast("string"))
    schema = T.StructType([*mine.schema.fields, T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())])

    def keys(batches):
        for batch in batches:
            for part, words in _texts(batch, "text"):
                at, k1, k2 = text_keys(words)
                some = batch.slice(part.start, part.stop - part.start)
                where = np.full(some.num_rows, -1)
                where[at] = np.arange(len(at))
                take = pa.array(np.maximum(where, 0), mask=where < 0)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(k1).take(take), pa.array(k2).take(take)], names=[*some.schema.names, "k1", "k2"])

    mine = mine.mapInArrow(keys, schema)
    stay = found.where("kept").select("doc_id", "k1", "k2").distinct()
    same = [mine[c].eqNullSafe(stay[c]) for c in ("doc_id", "k1", "k2")]
    mine = mine.join(stay, same[0] & same[1] & same[2], "left_semi").dropDuplicates(["doc_id", "k1", "k2"])
    return out.unionByName(mine.select("row.*"))
