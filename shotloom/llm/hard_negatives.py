"""Hard negatives of anchors, by integer inner products that are worked out bit by bit.

A component becomes an integer, and a vector travels as its bit-planes, in packs of rows. A product with an anchor is the
sum of one product per plane, weighted by powers of two, from the most significant plane down. After each plane the score
is known within an interval, as the planes to come add between nothing and all of the anchor's positive (or negative)
components; a pair is dropped once its interval misses every range that the anchor still has room in. While many pairs are
left a plane is one matrix product; when few are, it is worked out for those pairs alone. What lies in all ranges after
the last plane has its exact score.

Anchors are a stated share of the rows. Packs of rows meet packs of anchors in groups of bounded size, each pair of groups
once, and a group returns the best few of each range, which are ranked over all groups. Two searches run: an anchor's
positives (the best rows of its label), and, for each positive, the best rows of other labels in a range of scores that
the positive's score gives.

Defined cases: rows with a null id or label, or a vector that is null, empty or holds a null or non-finite component take
no part; vectors of different lengths never meet; repeated rows are rows of their own, and rows of an anchor's id are
never its positives or negatives; integers whose products could leave the range of a long are an error; an anchor without
positives or without negatives in range has no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import free, staged

#: Rows of a pack (a key holds a row's place in 12 bits); of a group of packs; anchors of a group; rows of a tile at first and at most.
PACK, GROUP_ROWS, GROUP_ANCHORS, TILE = 4096, 16_384, 1024, (128, 2048)
#: The share of pairs below which they are worked out one by one.
SPARSE = 0.05
_PACKED = "kind int, pack long, n long, dim int, planes int, ids binary, labels binary, body binary"
_FOUND = "anchor long, anchor_id long, range int, id long, score long"
#: Scores lie within this, so that sums of two of them are longs.
REACH = 2**61


def usable(vector: Column) -> Column:
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def to_planes(ints: np.ndarray) -> tuple[int, np.ndarray]:
    """How many planes integers take, and the planes of the integers raised by half their range, most significant first."""
    planes = int(max(int(ints.max()), -int(ints.min()) - 1, 0)).bit_length() + 1
    raised = (ints + (1 << (planes - 1))).astype(np.uint64)
    bits = [np.packbits((raised >> np.uint64(b) & np.uint64(1)).astype(bool), axis=1) for b in reversed(range(planes))]
    return planes, np.stack(bits)


def pack(rows: DataFrame, scale: float, is_anchor: str) -> DataFrame:
    """Rows (id, label, v) to packs: all rows as bit-planes (kind 0), and anchors as integers (kind 1)."""
    tagged = rows.select("id", "label", "v", F.expr(is_anchor).alias("anchor"), F.spark_partition_id().cast("long").alias("part"))

    def run(batches):
        held: dict[tuple[int, int], list] = {}
        made = 0

        def out(kind: int, dim: int, part: int) -> pa.RecordBatch:
            nonlocal made
            ids, labels, ints = (np.concatenate(x) for x in zip(*held.pop((kind, dim)), strict=True))
            order = np.argsort(ids, kind="stable")
            ids, labels, ints = ids[order], labels[order], ints[order]
            planes, body = to_planes(ints) if kind == 0 else (0, ints)
            made += 1
            cells = [kind, (part << 20) + made, len(ids), dim, planes, ids.tobytes(), labels.tobytes(), body.tobytes()]
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)], names=["kind", "pack", "n", "dim", "planes", "ids", "labels", "body"])

        part = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "label"))
            anchor = batch.column("anchor").to_numpy(zero_copy_only=False).astype(bool)
            sizes = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(sizes)
            for dim in np.unique(sizes).tolist():
                of = np.flatnonzero(sizes == dim)
                scaled = np.floor(scale * flat[(ends[of] - dim)[:, None] + np.arange(dim)])
                if np.abs(scaled).max() >= 2**62:
                    raise ValueError("a component's integer leaves the range of a long")
                ints = scaled.astype(np.int64)
                for kind, some in ((0, np.arange(len(of))), (1, np.flatnonzero(anchor[of]))):
                    for k in range(0, len(some), PACK):
                        at = some[k : k + PACK]
                        rows = held.setdefault((kind, dim), [])
                        if sum(len(r[0]) for r in rows) + len(at) > PACK:
                            yield out(kind, dim, part)
                            rows = held.setdefault((kind, dim), [])
                        rows.append((ids[of[at]], labels[of[at]], ints[at]))
        for kind, dim in list(held):
            yield out(kind, dim, part)

    return tagged.mapInArrow(run, _PACKED)


class Ranges:
    """Ranges of scores (anchor, low, high) and the k best (score, id) found so far in each."""

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        order = np.argsort(anchor, kind="stable")
        self.order, self.anchor, self.low, self.high, self.k = order, anchor[order], low[order], high[order], k
        self.best = self.low.copy()  # below this nothing qualifies any more
        self.of, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.first = np.searchsorted(self.anchor, np.arange(int(anchor.max()) + 2 if len(anchor) else 1))

    def envelope(self, anchors: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.full(anchors, REACH, np.int64), np.full(anchors, -REACH, np.int64)
        np.minimum.at(low, self.anchor, self.best)
        np.maximum.at(high, self.anchor, self.high)
        return low, high

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Exact scores of pairs: each goes to the ranges of its anchor that it lies in."""
        first, last = self.first[anchor], self.first[anchor + 1]
        parts = [(self.of, self.score, self.id)]
        for j in range(int((last - first).max()) if len(anchor) else 0):
            w = first + j
            on = np.flatnonzero(w < last)
            on = on[(score[on] >= self.best[w[on]]) & (score[on] <= self.high[w[on]])]
            parts.append((w[on], score[on], ids[on]))
        of, score, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, -score, of))
        of, score, ids = of[order], score[order], ids[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        kept = place < self.k
        self.of, self.score, self.id = of[kept], score[kept], ids[kept]
        full = place == self.k - 1
        self.best[of[full]] = np.maximum(self.best[of[full]], score[full])


def sliced_search(bits: np.ndarray, dim: int, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, anchor_ids: np.ndarray, anchor_labels: np.ndarray, same: bool, ranges: Ranges) -> int:
    """Add to ``ranges`` the rows of a pack (planes x rows x bytes) with an anchor's label (or with others, for same=False).

    Returns how many pairs were worked out to the last plane.
    """
    planes, n, _ = bits.shape
    most = int(np.abs(anchors).sum(1).max()) << planes
    if most >= REACH:
        raise ValueError(f"an inner product may lie beyond {REACH}")
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64  # exact, every one
    by, plus, minus = anchors.T.astype(kind), np.maximum(anchors, 0).sum(1), np.minimum(anchors, 0).sum(1)
    base = -(anchors.sum(1) << (planes - 1))
    first, size, done = 0, TILE[0], 0
    while first < n:
        at = slice(first, min(first + size, n))
        rows = np.arange(n)[at]
        live = (labels[rows, None] == anchor_labels) == same
        live &= ids[rows, None] != anchor_ids
        score = np.broadcast_to(base.astype(kind), live.shape).copy()
        low, high = ranges.envelope(len(anchors))
        s = t = None
        for k in range(planes):
            b = planes - 1 - k
            bit = np.unpackbits(bits[k, at], axis=1, count=dim).astype(kind)
            rest = (1 << b) - 1
            up, down = low - rest * plus, high - rest * minus
            if s is None:
                score += (bit @ by) * kind(1 << b)
                live &= (score >= up) & (score <= down)
                if b and np.count_nonzero(live) < SPARSE * live.size:
                    s, t = np.nonzero(live)
                    score = score[s, t]
            else:
                score = score + np.einsum("ij,ij->i", bit[s], by.T[t]) * kind(1 << b)
                ok = (score >= up[t]) & (score <= down[t])
                s, t, score = s[ok], t[ok], score[ok]
        if s is None:
            s, t = np.nonzero(live)
            score = score[s, t]
        done += len(s)
        ranges.add(t, score.astype(np.int64), ids[rows[s]])
        first, size = at.stop, min(2 * size, TILE[1])
    return done


def _search(rows: DataFrame, anchors: DataFrame, wanted: DataFrame | None, groups: int, blocks: int, k: int) -> DataFrame:
    """The k best of each range, over all groups of rows and blocks of anchors: positives where no ranges are wanted."""
    none = F.lit(None).cast("array<struct<anchor:long,range:int,low:long,high:long>>").alias("wanted")
    both = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), none)
    both = both.unionByName(anchors.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), none))
    if wanted is not None:
        lists = wanted.select("block", "wanted", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
        both = both.unionByName(lists.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    same = wanted is None

    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        rows, known = table.filter(pa.array(kinds == 0)).to_pylist(), table.filter(pa.array(kinds == 1)).to_pylist()
        asked: dict[int, list] = {}
        for cell in table.filter(pa.array(kinds == 2)).column("wanted").to_pylist():
            for r in cell:
                asked.setdefault(r["anchor"], []).append((r["range"], r["low"], r["high"]))
        out = {c: [] for c in ("anchor", "anchor_id", "range", "id", "score")}
        for dim in {r["dim"] for r in known}:
            of = [r for r in known if r["dim"] == dim]
            key = np.concatenate([(r["pack"] << 12) + np.arange(r["n"]) for r in of])
            ids, labels, ints = (np.concatenate([np.frombuffer(r[c], np.int64) for r in of]) for c in ("ids", "labels", "body"))
            ints = ints.reshape(len(ids), dim)
            if same:
                at, number = np.arange(len(ids)), np.zeros(len(ids), np.int64)
                low, high = np.full(len(ids), -REACH), np.full(len(ids), REACH)
            else:
                own = [(i, *x) for i, a in enumerate(key.tolist()) for x in asked.get(a, ())]
                if not own:
                    continue
                at, number, low, high = np.array(own, np.int64).T
            ranges = Ranges(at, low, high, k)
            for r in rows:
                if r["dim"] == dim:
                    bits = np.frombuffer(r["body"], np.uint8).reshape(r["planes"], r["n"], -1)
                    sliced_search(bits, dim, np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64), ints, ids, labels, same, ranges)
            a = ranges.anchor[ranges.of]
            for c, x in zip(out, (key[a], ids[a], number[ranges.order][ranges.of], ranges.id, ranges.score), strict=True):
                out[c].append(x)
        cols = {c: np.concatenate(x) if x else np.empty(0, np.int64) for c, x in out.items()}
        return pa.table({c: pa.array(x, pa.int32() if c == "range" else pa.int64()) for c, x in cols.items()})

    found = both.groupBy("group", "block").applyInArrow(run, _FOUND)
    best = Window.partitionBy("anchor", "range").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: str = "id % 100 = 0", positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: float = 256.0) -> DataFrame:
    """Rows (id, label, v: array of numbers) to anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its best rows of the same label. A negative of a positive has another label and a score of
    ``least`` to ``most`` hundredths of the positive's; the best ``negatives`` come back, ranked from 1. Higher scores are
    better, then smaller ids. Components are rounded down after multiplication by ``scale``.
    """
    sound = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<double>").alias("v"))
    sound = sound.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    packs = staged(pack(sound, scale, is_anchor), "bit-planes")
    totals = packs.groupBy("kind").agg(F.sum("n").alias("n"))
    size = {r["kind"]: r["n"] for r in totals.collect()}  # two rows
    groups, blocks = (max(1, -(-size.get(kind, 0) // most_of)) for kind, most_of in ((0, GROUP_ROWS), (1, GROUP_ANCHORS)))
    spread = lambda kind, name, n: packs.where(F.col("kind") == kind).withColumn(name, F.pmod(F.xxhash64("pack"), F.lit(n)).cast("int"))
    members, anchors = spread(0, "group", groups), spread(1, "block", blocks)
    good = staged(_search(members, anchors, None, groups, blocks, positives), "positives")
    # ranges of whole scores: 30 p <= 100 n <= 90 p
    low, high = F.ceil(F.col("score") * least / F.lit(100).cast("decimal(3,0)")), F.floor(F.col("score") * most / F.lit(100).cast("decimal(3,0)"))
    asked = good.select("anchor", "rank", low.cast("long").alias("low"), high.cast("long").alias("high")).where("low <= high")
    # an anchor's key is its pack's number and its place there; a block's list has `positives` ranges an anchor
    block = F.pmod(F.xxhash64(F.shiftright("anchor", 12)), F.lit(blocks)).cast("int")
    wanted = asked.groupBy(block.alias("block")).agg(F.collect_list(F.struct("anchor", F.col("rank").alias("range"), "low", "high")).alias("wanted"))
    bad = _search(members, anchors, wanted, groups, blocks, negatives)
    pairs = good.select("anchor", F.col("rank").alias("range"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = bad.join(pairs, ["anchor", "range"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out = staged(out, "hard-negatives")
    free(packs, good)
    return out
