"""Bootstrap and permutation by hashes: the same draws whatever the partitioning, and in any SQL engine.

Rows are first summed to units (rows, clusters), so a replicate draws units and joins their sums; the work is replicates
times units, never replicates times rows of a cluster. Draw (seed, replicate, slot) is the unit at the first 32 bits of
an md5, modulo the number of units.

Units' sums travel as arrays, a block of units in a row, to tasks that have a few replicates each (a turn). There a block is
summed before the next is read, or, in the bootstrap of units, up to ``MOST_UNITS`` of a stratum are held at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, groupby
from math import ceil, comb, sqrt
from statistics import fmean, median, variance

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import lgamma
from .ranks import ordinal

#: The reference's number of replicates.
REPLICATES = 10_000
#: Different values, or units, of a chunk of the bootstrap by counts; parts of their hashes that chunks are made of; tasks
#: that chunks and turns make together, about.
CHUNK, BUCKETS, TASKS = 1 << 19, 1 << 16, 192
#: Units of a chunk that labels are dealt in.
DEALT_UNITS = 4096
#: Turns that replicates are dealt to; units of a block; units whose sums (16 bytes each) a task of the bootstrap of units
#: holds at once: of larger strata each part draws all, and keeps its own.
TURNS, BLOCK, MOST_UNITS = 96, 1 << 16, 1 << 24
#: Rows of a value from which on draws of values are faster than draws of rows.
SHARED = 4
#: Below this number of units draws of several replicates are digested together.
FEW_DRAWS = 1024


def draw(seed: int, *parts: str | Column) -> Column:
    """32 uniform bits of a hash of the seed and the parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def units(df: DataFrame, value: str, cluster: str, *strata: str) -> DataFrame:
    """Sums of each cluster, numbered from 0 in the order of their labels (within each stratum); a null label is an error."""
    label = F.coalesce(F.col(cluster), F.raise_error(F.lit(f"{cluster} must not be null")))
    sums = df.select(*strata, label.alias("unit"), F.col(value).cast("double").alias("v")).groupBy(*strata, "unit").agg(F.count("v").alias("n"), F.sum("v").alias("s1"), F.sum(F.col("v") * F.col("v")).alias("s2"))
    return ordinal(sums, ["unit"], list(strata), "pos")


def _blocks(unit_sums: DataFrame, by: list[str], columns: list[str], size: int | None = None) -> DataFrame:
    """(by, block) and arrays of doubles of the columns (bytes, for ``label``: with their lengths), in the order of ``pos``."""
    import numpy as np
    import pyarrow as pa

    def pack(table: pa.Table) -> pa.Table:
        own = table.sort_by("pos")
        out = own.select([*by, "block"]).slice(0, 1)
        for c in columns:
            if c == "label":
                texts = [x.encode() for x in own.column(c).to_pylist()]
                out = out.append_column("lengths", pa.array([np.fromiter(map(len, texts), np.int64, len(texts)).tobytes()]))
                out = out.append_column(c, pa.array([b"".join(texts)]))
            else:
                out = out.append_column(c, pa.array([own.column(c).to_numpy().astype(np.float64).tobytes()]))
        return out

    # a unit whose values are all missing has no sum
    values = [F.col(c) if c == "label" else F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]
    rows = unit_sums.select(*by, F.floor(F.col("pos") / (size or BLOCK)).alias("block"), "pos", *values)
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (*by, "block")]
    packed = [f"`{x}` binary" for c in columns for x in (("lengths", c) if c == "label" else (c,))]
    return rows.groupBy(*by, "block").applyInArrow(pack, ", ".join([*kinds, *packed]))


def _turns(blocks: DataFrame, replicates: int, *order: str) -> tuple[DataFrame, int]:
    """Blocks for each turn, a partition each and in order, and the number of replicates of a turn."""
    step = max(1, -(-replicates // TURNS))
    turns = -(-replicates // step)
    spread = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))
    return spread.repartitionById(turns, "turn").sortWithinPartitions("turn", *order, "block"), step


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):  # a block at a time
            yield batch.slice(i, 1).to_pylist()[0]


def _ids(turn: int, step: int, replicates: int) -> list[int]:
    return list(range(turn * step + 1, min((turn + 1) * step, replicates) + 1))


def drawn_slots(seed: int, ids: list[int], prefix: str, m: int) -> Iterator[tuple]:
    """(which replicate, the units drawn by some of its slots), until each of the replicates has drawn m times."""
    import numpy as np

    from ..functions.digest import first_bits, number_tiles, text_tiles

    def within(h: np.ndarray) -> np.ndarray:
        return (h if m > 0xFFFFFFFF else h - h // np.uint32(m) * np.uint32(m)).astype(np.intp)

    if m >= FEW_DRAWS:
        for _, tile in number_tiles(0, m):
            for i, r in enumerate(ids):
                yield i, within(first_bits(f"{seed}:{r}:{prefix}".encode(), tile))
        return
    texts = [f"{r}:{prefix}{s}".encode() for r in ids for s in range(m)]
    pos = np.empty(len(texts), np.intp)
    for at, tile in text_tiles(np.fromiter(map(len, texts), np.int64, len(texts)), b"".join(texts)):
        pos[at] = within(first_bits(f"{seed}:".encode(), tile))
    for i in range(len(ids)):
        yield i, pos[i * m : (i + 1) * m]


def bootstrap_means(unit_sums: DataFrame, replicates: int, seed: int = 42, strata: tuple[str, ...] = ()) -> DataFrame:
    """(replicate, mean) of resamples of whole units with replacement; each stratum keeps its number of units.

    Draws are made where a stratum's sums lie in an array, so that neither draws nor counts of them are shuffled. Units
    without a stratum take no part.
    """
    import numpy as np
    import pyarrow as pa

    most = max(1, MOST_UNITS // BLOCK)  # blocks
    known = unit_sums.dropna(subset=list(strata)) if strata else unit_sums
    blocks = _blocks(known, list(strata), ["n", "s1"])
    sizes = known.groupBy(*strata).agg(F.count("*").alias("m"))
    prefix = F.concat(*[x for c in strata for x in (F.col(c).cast("string"), F.lit(":"))]) if strata else F.lit("")
    blocks = (blocks.join(F.broadcast(sizes), list(strata)) if strata else blocks.withColumn("m", sizes.scalar())).withColumn("prefix", prefix).withColumn("part", F.floor(F.col("block") / most))
    spread, step = _turns(blocks, replicates, *strata, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[float]] = {}
        for (turn, part, m, text, *_), found in groupby(_rows(batches), lambda x: (x["turn"], x["part"], x["m"], x["prefix"], *[x[c] for c in strata])):
            parts = [(np.frombuffer(x["n"]), np.frombuffer(x["s1"])) for x in found]
            n, s1 = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            ids, low = _ids(turn, step, replicates), part * most * BLOCK
            for i, pos in drawn_slots(seed, ids, text, m):
                if len(n) < m:
                    pos = pos[(pos >= low) & (pos < low + len(n))] - low
                total = sums.setdefault(ids[i], [0.0, 0.0])
                total[0] += float(n[pos].sum())
                total[1] += float(s1[pos].sum())
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([int(x[0]) for x in sums.values()], pa.int64()), pa.array([x[1] for x in sums.values()], pa.float64())], names=["replicate", "n", "s1"])

    drawn = spread.mapInArrow(run, "replicate int, n long, s1 double")
    return drawn.select("replicate", (F.col("s1") / F.col("n")).alias("mean"))


def bootstrap_summary(means: DataFrame, unit_sums: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Estimate, standard error, bias and percentile interval, with warnings."""
    return _summary(means, unit_sums.agg(F.sum("s1") / F.sum("n")).scalar(), unit_sums.agg(F.count("*")).scalar(), confidence)


def _summary(means: DataFrame, estimate: Column, n_units: Column, confidence: float = 0.95) -> DataFrame:
    tail = (1 - confidence) / 2
    s = means.agg(F.count("mean").alias("replicates"), F.stddev_samp("mean").alias("se"), F.avg("mean").alias("center"), F.percentile("mean", F.array(F.lit(tail), F.lit(1 - tail))).alias("ci"))
    bias = F.col("center") - F.col("estimate")
    warn = F.array_compact(F.array(F.when(F.col("replicates") < 1000, F.lit("fewer than 1000 resamples")), F.when(F.col("units") < 20, F.lit("fewer than 20 units")), F.when(F.abs("bias") > 0.25 * F.col("se"), F.lit("bias is over a quarter of the standard error"))))
    rows = s.withColumn("estimate", estimate).withColumn("units", n_units).withColumn("bias", bias)
    return rows.select("replicates", "units", "estimate", "se", "bias", F.col("ci")[0].alias("low"), F.col("ci")[1].alias("high"), warn.alias("warnings"))


class Drawn:
    """Resamples of weighted items (side, key, w and columns), each side's as many draws as its weights add up to.

    Items lie in chunks by a hash of their key. A replicate's draws fall on the chunks by their weights (multinomial), then on
    a chunk's items (``functions.draws``): the same as drawing from all. So a replicate's work grows with the items, and what
    is sent is a chunk's columns, packed, for each turn; there are the fewer turns the more chunks there are. Draws depend on
    seed, side, replicate and chunk, not on partitions. The items are kept on disk from their counting on, so that what they
    are made from is passed over once.
    """

    def __init__(self, items: DataFrame, columns: list[str], **totals: Column):
        import numpy as np

        self.columns = columns
        placed = items.persist(StorageLevel.DISK_ONLY).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
        found = placed.groupBy("side", "bucket").agg(F.count("*").alias("items"), F.sum("w").alias("m"), *[c.alias(k) for k, c in totals.items()]).collect()
        self.m = {s: sum(r["m"] for r in found if r["side"] == s) for s in {r["side"] for r in found}}
        self.totals = {k: sum(r[k] or 0 for r in found) for k in totals}
        self.items = sum(r["items"] for r in found)
        self.chunks = max(1, -(-self.items // CHUNK))
        self.sizes = {s: np.zeros(self.chunks) for s in self.m}
        for r in found:
            self.sizes[r["side"]][r["bucket"] * self.chunks // BUCKETS] += r["m"]
        self.placed = placed.withColumn("chunk", F.floor(F.col("bucket") * self.chunks / BUCKETS).cast("int"))

    def sums(self, expand, names: list[str], replicates: int, seed: int) -> DataFrame:
        """(side, replicate, names): sums over each replicate's draws of what ``expand`` makes of the columns, an array of a column a name."""
        import numpy as np
        import pyarrow as pa

        from ..functions.draws import TOGETHER, Weighted

        columns, sizes, whole = self.columns, self.sizes, self.m
        turns = min(TURNS, -(-TASKS // (self.chunks * max(1, len(whole)))))
        step = -(-replicates // (turns * TOGETHER)) * TOGETHER
        turns = -(-replicates // step)

        def pack(table: pa.Table) -> pa.Table:
            own = table.sort_by("key")
            out = own.select(["side", "chunk"]).slice(0, 1)
            for c in ("w", *columns):
                out = out.append_column(c, pa.array([own.column(c).to_numpy().astype(np.float64).tobytes()]))
            return out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in _rows(batches):
                side, chunk = x["side"], x["chunk"]
                share = sizes[side] / whole[side]
                own = Weighted(expand(*[np.frombuffer(x[c]) for c in columns]), np.frombuffer(x["w"]), sizes[side][chunk])
                ids, got = _ids(x["turn"], step, replicates), []
                for i in range(0, len(ids), TOGETHER):
                    n = [np.random.default_rng([seed, side, r]).multinomial(whole[side], share)[chunk] for r in ids[i : i + TOGETHER]]
                    got.append(own.sums(np.random.default_rng([seed, side, ids[i], chunk, 9]), np.array(n)))
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array([side] * len(ids), pa.int32()), pa.array(ids, pa.int32()), *[pa.array(c) for c in np.concatenate(got).T]], names=["side", "replicate", *names])

        packed = self.placed.select("side", "chunk", "key", "w", *columns).groupBy("side", "chunk").applyInArrow(pack, ", ".join(["side int", "chunk int", *[f"`{c}` binary" for c in ("w", *columns)]]))
        spread = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))
        place = ((F.col("side") * self.chunks + F.col("chunk")) * turns + F.col("turn")).cast("int")
        drawn = spread.withColumn("place", place).repartitionById((max(whole, default=0) + 1) * self.chunks * turns, "place")
        drawn = drawn.mapInArrow(run, ", ".join(["side int", "replicate int", *[f"`{c}` double" for c in names]]))
        return drawn.groupBy("side", "replicate").agg(*[F.sum(c).alias(c) for c in names])


def _powers(v):
    """What a draw of each value adds to the number of known values, and to the finite ones' sum and sum of squares."""
    import numpy as np

    x = np.where(np.isfinite(v), v, 0.0)
    return np.column_stack([~np.isnan(v), x, x * x])


def _powers_and_ends(v):
    import numpy as np

    return np.column_stack([_powers(v), v == np.inf, v == -np.inf])


def bootstrap_row_sums(df: DataFrame, value: str, key: str, replicates: int, seed: int = 42, side: Column | None = None) -> DataFrame:
    """(replicate, n, s1, s2) of resamples of single rows with replacement; with ``side`` (whole numbers from 0), of each side's rows.

    Rows are alike if their values are, so they are counted by value and a replicate draws how often each value occurs: its
    work grows with the different values, and who the rows are by their ``key`` doesn't matter.
    """
    counts = df.select((F.lit(0) if side is None else side).cast("int").alias("side"), F.col(value).cast("double").alias("key")).groupBy("side", "key").agg(F.count("*").alias("w"))
    drawn = Drawn(counts.withColumn("v", F.col("key")), ["v"], ends=F.count_if(F.abs("key") == float("inf")))
    s1, s2 = F.col("s1"), F.col("s2")
    if drawn.totals["ends"]:
        sums = drawn.sums(_powers_and_ends, ["n", "s1", "s2", "up", "down"], replicates, seed)
        end = lambda c, x: F.when(F.col(c) > 0, F.lit(x)).otherwise(F.lit(0.0))
        s1, s2 = s1 + end("up", float("inf")) + end("down", float("-inf")), s2 + end("up", float("inf")) + end("down", float("inf"))
    else:
        sums = drawn.sums(_powers, ["n", "s1", "s2"], replicates, seed)
    return sums.select(*([] if side is None else ["side"]), "replicate", F.col("n").cast("long").alias("n"), s1.alias("s1"), s2.alias("s2"))


def bootstrap_row_means(df: DataFrame, value: str, key: str, replicates: int, seed: int = 42) -> DataFrame:
    """(replicate, mean) of resamples of single rows with replacement."""
    return bootstrap_row_sums(df, value, key, replicates, seed).select("replicate", (F.col("s1") / F.col("n")).alias("mean"))


def compare_resampling_units(df: DataFrame, value: str, key: str, cluster: str, replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """Summaries of the bootstraps by rows and by whole clusters, one row each, and the clusters' standard error over the rows'.

    Both draw how often each value, or cluster, occurs; the clusters' draws are not those of ``bootstrap_means``' hashes, of
    which there would be one for each cluster and replicate.
    """
    import numpy as np

    label = F.coalesce(F.col(cluster), F.raise_error(F.lit(f"{cluster} must not be null")))
    sums = df.select(label.alias("key"), F.col(value).cast("double").alias("v")).groupBy("key").agg(F.count("v").alias("n"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("s1"), F.count("*").alias("rows"))
    clusters = Drawn(sums.select(F.lit(0).alias("side"), "key", F.lit(1).cast("long").alias("w"), "n", "s1", "rows"), ["n", "s1"], n=F.sum("n"), s1=F.sum("s1"), rows=F.sum("rows"))
    by_cluster = clusters.sums(lambda n, s1: np.column_stack([n, s1]), ["n", "s1"], replicates, seed + 1).select("replicate", F.try_divide("s1", "n").alias("mean"))
    n, s1 = clusters.totals["n"], clusters.totals["s1"]
    estimate = F.lit(s1 / n if n else None).cast("double")
    both = [_summary(means, estimate, F.lit(of).cast("long")).withColumn("unit", F.lit(unit)) for unit, means, of in (("row", bootstrap_row_means(df, value, key, replicates, seed), clusters.totals["rows"]), ("cluster", by_cluster, clusters.items))]
    ratio = F.max(F.when(F.col("unit") == "cluster", F.col("se"))).over(Window.partitionBy()) / F.max(F.when(F.col("unit") == "row", F.col("se"))).over(Window.partitionBy())  # two rows
    return both[0].unionByName(both[1]).select("unit", *[c for c in both[0].columns if c != "unit"], ratio.alias("se_ratio"))


def bootstrap_callable(df: DataFrame, statistic, replicates: int, seed: int = 42, most: int = 1_000_000) -> DataFrame:
    """(replicate, stat) for any function of a sample's values (a numpy array).

    Such a function sees a whole resample at once, so a task must hold one: more than ``most`` rows are an error. Medians,
    quantiles and trimmed means of larger tables are in ``order_bootstrap``.
    """
    import numpy as np
    import pandas as pd

    found = df.select(F.col(df.columns[0]).cast("double")).limit(most + 1).toArrow().column(0)
    if len(found) > most:
        raise ValueError(f"more than {most} rows; use a bootstrap of sums")
    values = np.sort(found.drop_null().to_numpy())
    shared = df.sparkSession.sparkContext.broadcast(values)

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"replicate": f["id"], "stat": [float(statistic(np.random.default_rng([seed, int(r)]).choice(shared.value, len(shared.value)))) for r in f["id"]]})

    return df.sparkSession.range(1, replicates + 1).mapInPandas(run, "replicate long, stat double")


STATISTICS = ("mean_difference", "median_difference", "welch_t")
#: Labellings that are enumerated at most, and units below which a warning is given.
MOST_LABELLINGS, FEW = 50_000, 8
#: Standard deviations of a rank's hash within which units are put in order.
NEAR = 10


def _labels(unit_sums: DataFrame, group: str, first) -> DataFrame:
    """A row per unit with its sums and whether it lies in the first group; a unit in both groups is an error."""
    labels = unit_sums.groupBy("unit").agg(F.count_distinct(group).alias("g"), F.max((F.col(group) == first).cast("int")).alias("is_first"), *[F.sum(c).alias(c) for c in ("n", "s1", "s2")])
    return labels.withColumn("is_first", F.when(F.col("g") > 1, F.raise_error(F.lit("a cluster lies in both groups"))).otherwise(F.col("is_first"))).drop("g")


def permutation_differences(unit_sums: DataFrame, group: str, first, replicates: int, seed: int = 42, statistic: str = "mean_difference", rows: DataFrame | None = None) -> DataFrame:
    """(replicate, difference) with labels dealt anew to units; each replicate keeps the number of first-group units.

    Unit by unit, the label goes to those of the smallest hashes. A unit in both groups is an error. ``difference`` is the
    statistic: of the rows' means, Welch's t, or of the rows' medians, which need the ``rows`` (unit, v) beside the sums.

    For sums no replicate is sorted: units whose hash lies clearly below the wanted rank are added up, and only those near
    it, some 20 times the root of the units, are put in order, ties by the unit.
    """
    labels = _labels(unit_sums, group, first)
    if statistic == "median_difference":
        k = labels.agg(F.sum("is_first")).scalar()
        reps = labels.select("unit", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
        rank = F.row_number().over(Window.partitionBy("replicate").orderBy(draw(seed, "replicate", "unit"), "unit"))
        dealt = rows.select("unit", "v").join(reps.withColumn("_a", rank <= k), "unit")
        return dealt.groupBy("replicate").agg(difference("_a", statistic).alias("difference"))
    import numpy as np
    import pyarrow as pa

    m, k = labels.agg(F.count("*"), F.coalesce(F.sum("is_first"), F.lit(0))).first()
    share = k / max(1, m)
    half = NEAR * sqrt(share * (1 - share) / max(1, m)) + 64 / max(1, m)  # as a share of the hashes
    low, high = max(0, ceil((share - half) * 2**32)), min(2**32, ceil((share + half) * 2**32))
    numbered = ordinal(labels.withColumn("label", F.col("unit").cast("string")), ["unit"], name="pos")
    spread, step = _turns(_blocks(numbered, [], ["n", "s1", "s2", "label"]), replicates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..functions.digest import first_bits, text_tiles

        sums, near = {}, {}
        for x in _rows(batches):
            ids, values = _ids(x["turn"], step, replicates), np.stack([np.frombuffer(x[c]) for c in ("n", "s1", "s2")])
            sums = sums or {r: np.zeros(4) for r in ids}
            near = near or {r: [] for r in ids}
            for at, tile in text_tiles(np.frombuffer(x["lengths"], np.int64), x["label"]):
                own = np.vstack([np.ones(len(at)), values[:, at]])
                for r in ids:
                    h = first_bits(f"{seed}:{r}:".encode(), tile)
                    below = h < low
                    sums[r] += np.einsum("ij,j->i", own, below.astype(np.float64))
                    edge = np.flatnonzero(~below & (h < high))
                    near[r].append((h[edge], x["block"] * BLOCK + at[edge], own[:, edge]))
        for r in sums:
            h, pos, own = (np.concatenate(v, axis=-1) for v in zip(*near.pop(r), strict=True))
            wanted = k - int(sums[r][0])
            if not 0 <= wanted <= len(h):
                raise ValueError("the hashes of a replicate are not uniform")
            sums[r] += own[:, np.lexsort((pos, h))[:wanted]].sum(1)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *[pa.array([float(v[i]) for v in sums.values()]) for i in (1, 2, 3)]], names=["replicate", "n", "s1", "s2"])

    return _against_others(spread.mapInArrow(run, "replicate int, n double, s1 double, s2 double"), labels, statistic, "replicate")


def _against_others(sums: DataFrame, labels: DataFrame, statistic: str, *keep: str) -> DataFrame:
    """(keep, difference) of the sums of the labelled units (a row per replicate) against those of all others."""
    whole = labels.agg(F.struct(*[F.sum(c).cast("double").alias(c) for c in ("n", "s1", "s2")])).scalar()
    both = sums.withColumn("w", whole).select(*keep, F.explode(F.array(*[F.struct(F.lit(yes).alias("_a"), *[(F.col(c) if yes else F.col(f"w.{c}") - F.col(c)).alias(c) for c in ("n", "s1", "s2")]) for yes in (True, False)])).alias("x"))
    return both.select(*keep, "x.*").groupBy(*keep).agg(difference("_a", statistic).alias("difference"))


def dealt_over(seed: int, replicate: int, chosen: int, units_: int, rows: int, begin: int, end: int) -> list[int]:
    """How many of ``chosen`` out of all units fall to each of the chunks of ``rows`` units from ``begin`` to ``end``, without it.

    Halves share them by hypergeometric draws, each half's with a generator of its own, so any chunks may be asked for.
    """
    import numpy as np

    size = lambda i, j: min(j * rows, units_) - i * rows

    def walk(first: int, last: int, node: int, chosen: int) -> Iterator[int]:
        if last <= begin or first >= end:
            return
        if last - first == 1:
            yield chosen
            return
        mid = (first + last) // 2
        left = int(np.random.default_rng([seed, replicate, node, 5]).hypergeometric(size(first, mid), size(mid, last), chosen))
        yield from walk(first, mid, 2 * node, left)
        yield from walk(mid, last, 2 * node + 1, chosen - left)

    return list(walk(0, -(-units_ // rows), 1, chosen))


def dealt_to(seed: int, replicate: int, chosen: int, units_: int, rows: int, chunk: int) -> int:
    """``dealt_over`` of one chunk."""
    return dealt_over(seed, replicate, chosen, units_, rows, chunk, chunk + 1)[0]


def permutation_dealt(unit_sums: DataFrame, group: str, first, replicates: int, seed: int = 42, statistic: str = "mean_difference", rows: int = DEALT_UNITS) -> DataFrame:
    """(replicate, labelled, difference) as ``permutation_differences``, without ranking the units of each replicate.

    Units lie in chunks; a replicate's first-group labels are dealt to the chunks by hypergeometric draws, then to units
    inside each chunk, so work is linear and a task holds a block of chunks. Every replicate labels the same number of units.
    """
    import numpy as np
    import pyarrow as pa

    labels = ordinal(_labels(unit_sums, group, first), ["unit"], name="pos")
    m, k = labels.agg(F.count("*"), F.sum("is_first")).first()
    if m >= 10**9:
        raise ValueError("a billion units or more can't be dealt")
    many = max(1, BLOCK // rows)  # chunks of a block
    spread, step = _turns(_blocks(labels, [], ["n", "s1", "s2"], many * rows), replicates)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in _rows(batches):
            x = np.stack([np.frombuffer(b[c]) for c in ("n", "s1", "s2")])
            chunks = -(-x.shape[1] // rows)
            for r in _ids(b["turn"], step, replicates):
                total = sums.setdefault(r, np.zeros(4))
                for c, take in enumerate(dealt_over(seed, r, k, m, rows, b["block"] * many, b["block"] * many + chunks)):
                    own = x[:, c * rows : (c + 1) * rows]
                    at = np.random.default_rng([seed, r, b["block"] * many + c, 6]).permutation(own.shape[1])[:take]
                    total += (take, *own[:, at].sum(1))
        if sums:
            cols = [pa.array(list(sums), pa.int64()), pa.array([int(v[0]) for v in sums.values()], pa.int64()), *[pa.array([float(v[i]) for v in sums.values()]) for i in (1, 2, 3)]]
            yield pa.RecordBatch.from_arrays(cols, names=["replicate", "labelled", "n", "s1", "s2"])

    dealt = spread.mapInArrow(deal, "replicate long, labelled long, n double, s1 double, s2 double")
    return _against_others(dealt, labels, statistic, "replicate", "labelled")


def difference(flag: str, statistic: str = "mean_difference") -> Column:
    """The statistic of the flagged units' rows against the others'."""
    on = lambda c, yes: F.when(F.col(flag) if yes else ~F.col(flag), F.col(c))
    if statistic == "median_difference":
        return F.percentile(on("v", True), F.lit(0.5)) - F.percentile(on("v", False), F.lit(0.5))
    part = lambda c, yes: F.sum(on(c, yes))
    means = [F.try_divide(part("s1", yes), part("n", yes)) for yes in (True, False)]
    if statistic == "mean_difference":
        return means[0] - means[1]
    if statistic != "welch_t":
        raise ValueError(f"unknown statistic {statistic!r}: {', '.join(STATISTICS)}")
    var = [F.try_divide(F.greatest(F.lit(0.0), part("s2", yes) - part("s1", yes) * m), (part("n", yes) - 1) * part("n", yes)) for yes, m in zip((True, False), means, strict=True)]
    return F.try_divide(means[0] - means[1], F.sqrt(var[0] + var[1]))


def permutation_test(unit_sums: DataFrame, group: str, first, replicates: int, seed: int = 42, statistic: str = "mean_difference", rows: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """Observed statistic, Monte Carlo p-values (1 + count) / (1 + replicates), the null's mean and deviation, and warnings.

    Warnings are of few units and of a smallest attainable two-sided p-value above 0.01. With ``dealt`` labels come from
    ``permutation_dealt`` instead of ranks of hashes; medians have ranks only.
    """
    labels = _labels(unit_sums, group, first)
    flagged = labels.withColumn("_a", F.col("is_first") == 1)
    if statistic == "median_difference":
        if rows is None:
            raise ValueError("medians need the rows (unit, v)")
        flagged = rows.select("unit", "v").join(flagged.select("unit", "_a"), "unit")
    observed = flagged.agg(difference("_a", statistic)).scalar()
    if dealt and statistic != "median_difference":
        null = permutation_dealt(unit_sums, group, first, replicates, seed, statistic)
    else:
        null = permutation_differences(unit_sums, group, first, replicates, seed, statistic, rows)
    null = null.withColumn("o", observed)
    slack = 1e-12 * F.greatest(F.lit(1.0), F.abs("o"))
    s = null.agg(F.first("o").alias("observed"), F.count("difference").alias("replicates"), F.count_if(F.col("difference") >= F.col("o") - slack).alias("up"), F.count_if(F.col("difference") <= F.col("o") + slack).alias("down"), F.avg("difference").alias("null_mean"), F.stddev_samp("difference").alias("null_sd"))
    p = lambda c: (F.col(c) + 1) / (F.col("replicates") + 1)
    sizes = labels.agg(F.struct(F.count("*").cast("double").alias("m"), F.sum("is_first").cast("double").alias("k"))).scalar()
    s = s.withColumn("z", sizes)
    m, k = F.col("z.m"), F.col("z.k")
    least = 2 * F.exp(lgamma(k + 1) + lgamma(m - k + 1) - lgamma(m + 1))
    warn = F.array_compact(F.array(F.when(m < FEW, F.lit("fewer than 8 units are permuted")), F.when(least > 0.01, F.lit("the smallest attainable p-value is above 0.01")))).alias("warnings")
    return s.select("observed", "replicates", p("up").alias("p_greater"), p("down").alias("p_less"), F.least(F.lit(1.0), 2 * F.least(p("up"), p("down"))).alias("p_value"), "null_mean", "null_sd", warn)


def permutation_auto(df: DataFrame, value: str, group: str, first, second, key: str, *, statistic: str = "mean_difference", replicates: int = REPLICATES, seed: int = 42, alternative: str = "two-sided", method: str = "auto") -> dict:
    """Single rows permuted: every labelling where there are at most 50,000, else ``replicates`` of them, dealt at random.

    Returns p_value, exact and the number of labellings or replicates. Only a sample that has so few labellings is
    brought to the driver.
    """
    if method not in ("auto", "exact", "monte-carlo") or alternative not in ("two-sided", "less", "greater"):
        raise ValueError("unknown method or alternative")
    rows = df.where(F.col(group).isin(first, second) & F.col(value).isNotNull()).select(F.col(key).alias("unit"), (F.col(group) == first).alias("is_first"), F.col(value).cast("double").alias("v"))
    n, k = rows.agg(F.count("*"), F.count_if("is_first")).first()
    few = n <= MOST_LABELLINGS and comb(n, k) <= MOST_LABELLINGS
    if method == "exact" and not few:
        raise ValueError("too many relabellings for enumeration")
    if method != "monte-carlo" and few:
        values = [(r["is_first"], r["v"]) for r in rows.orderBy("unit").collect()]
        p = exact_permutation([v for yes, v in values if yes], [v for yes, v in values if not yes], alternative, statistic)
        return {"p_value": p, "exact": True, "labellings": comb(n, k)}
    sums = units(rows, "v", "unit", "is_first")
    row = permutation_test(sums, "is_first", True, replicates, seed, statistic, rows, dealt=True).first()
    return {"p_value": row[{"two-sided": "p_value", "less": "p_less", "greater": "p_greater"}[alternative]], "exact": False, "labellings": row["replicates"]}


def _difference_of(statistic: str, a: list[float], b: list[float]) -> float:
    if statistic == "median_difference":
        return median(a) - median(b)
    gap = fmean(a) - fmean(b)
    if statistic == "mean_difference":
        return gap
    if statistic != "welch_t":
        raise ValueError(f"unknown statistic {statistic!r}: {', '.join(STATISTICS)}")
    se = sqrt(variance(a) / len(a) + variance(b) / len(b))
    return gap / se if se else float("nan")


def exact_permutation(values_a: list[float], values_b: list[float], alternative: str = "two-sided", statistic: str = "mean_difference") -> float:
    """All relabellings of two tiny samples (at most 50,000)."""
    both, k = [*values_a, *values_b], len(values_a)
    if comb(len(both), k) > MOST_LABELLINGS:
        raise ValueError("too many relabellings for enumeration")
    seen = _difference_of(statistic, values_a, values_b)
    stats = []
    for chosen in combinations(range(len(both)), k):
        mine = set(chosen)
        stats.append(_difference_of(statistic, [both[i] for i in chosen], [x for i, x in enumerate(both) if i not in mine]))
    slack = 1e-12 * max(1, abs(seen))
    up, down = (sum(f(s) for s in stats) / len(stats) for f in (lambda s: s >= seen - slack, lambda s: s <= seen + slack))
    return {"greater": up, "less": down, "two-sided": min(1.0, 2 * min(up, down))}[alternative]
