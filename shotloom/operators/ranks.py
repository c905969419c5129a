"""Ranks, running sums, numbers and quantiles of a whole table without a window over all of its rows.

Rows are first counted per distinct value; values are cut into ranges, summed inside each range, and the ranges' totals,
one row each, give the offsets. Any cuts give exact results: running sums cut at approximate quantiles, numbers of keys of
any type at a bounded sample of keys, and quantiles at steps of the value's logarithm, of which only those that hold a wanted
rank are looked into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 32
#: Keys that numbering cuts at, at most, and keys they are chosen from; a quantile's ranges for a value's growth by a factor e.
CUTS, SAMPLED = 128, 4096
LOG_STEPS = 1024


def running_sums(per: DataFrame, value: str, sums: dict[str, str], ranges: int = RANGES, descending: bool = False) -> DataFrame:
    """per: a row per distinct numeric value. Adds for each ``name: column`` the sum of column up to and with the value."""
    edges = sorted(set(per.approxQuantile(value, [k / ranges for k in range(1, ranges)], 0.01)))
    at = F.lit(0)
    for k, e in enumerate(edges, 1):
        at = F.when(F.col(value) > e, F.lit(k)).otherwise(at)
    rows = per.withColumn("_r", at)
    sign = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    inside = Window.partitionBy("_r").orderBy(sign(value)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy(sign("_r")).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    totals = rows.groupBy("_r").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    totals = totals.select("_r", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    rows = rows.join(F.broadcast(totals), "_r")  # at most `ranges` rows
    return rows.select(*per.columns, *[(F.sum(c).over(inside) + F.col(f"_b_{n}")).alias(n) for n, c in sums.items()])


def value_ranks(df: DataFrame, value: str, **counts: Column) -> DataFrame:
    """A row per distinct value: n (its rows), the given counts of them, ``upto`` (rows up to it) and the average ``rank``."""
    per = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in counts.items()])
    return running_sums(per, value, {"upto": "n"}).withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2)


def meet(left: DataFrame, right: DataFrame, keys: list[str], *columns: str, how: str = "inner") -> DataFrame:
    """Join columns of ``right`` to ``left`` by keys that may be null."""
    side = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *columns)
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(side, on, how).drop(*[f"_k_{k}" for k in keys])


def ordinal(df: DataFrame, order: list[str], groups: list[str] | None = None, name: str = "ordinal") -> DataFrame:
    """Adds a number from 0 in the ascending order of columns of any type, nulls first, within each group.

    Rows that are alike in the order get numbers in no stated order. The rows of one range are numbered in one task.
    """
    groups = groups or []
    key = F.struct(*order)
    sample = df.select(*order).orderBy(F.xxhash64(*order)).limit(SAMPLED).orderBy(*order).collect()
    cuts = sample[:: max(1, len(sample) // CUTS)]
    kinds = [df.schema[c].dataType for c in order]
    if len(order) == 1:  # plain values compare faster; what is null lies below all cuts
        key, cuts = F.col(order[0]), [r for r in cuts if r[0] is not None]
    value = lambda x, t: F.lit(x).cast(t)
    cut = lambda r: value(r[0], kinds[0]) if len(order) == 1 else F.struct(*[value(x, t).alias(c) for c, x, t in zip(order, r, kinds, strict=True)])

    def at(low: int, high: int) -> Column:
        """How many cuts are not above the key, by halving."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(cut(cuts[mid]) <= key, at(mid + 1, high)).otherwise(at(low, mid))

    rows = df.withColumn("_r", at(0, len(cuts)))
    before = Window.partitionBy(*groups).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = rows.groupBy(*groups, "_r").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    rows = meet(rows, offsets, [*groups, "_r"], "_before")
    own = F.row_number().over(Window.partitionBy(*groups, "_r").orderBy(*order))
    return rows.select(*df.columns, (F.col("_before") + own - 1).cast("long").alias(name))


def quantiles(counts: DataFrame, value: str, n: str, probabilities: list[float], groups: list[str] | None = None) -> DataFrame:
    """(groups, q: array) of exact quantiles, interpolated between neighbours, from a row per group and finite value with its count."""
    by = groups or ["_all"]
    rows = counts if groups else counts.withColumn("_all", F.lit(0))
    v = F.col(value).cast("double")
    # a step that never falls as the value rises
    rows = rows.withColumn("_step", F.floor(F.signum(v) * F.log1p(F.abs(v)) * LOG_STEPS))
    step = [*by, "_step"]
    whole = Window.partitionBy(*by)
    before = whole.orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(*step).agg(F.sum(n).alias("_n")).withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_m": F.sum("_n").over(whole)})
    place = [(F.col("_m") - 1) * p for p in probabilities]
    ranks = [f(x) for x in place for f in (F.floor, F.ceil)]
    wanted = F.exists(F.array(*ranks), lambda k: (k >= F.col("_before")) & (k < F.col("_before") + F.col("_n")))
    inside = meet(rows, ranges.where(wanted), step, "_before", "_m")
    last = F.col("_before") + F.sum(n).over(Window.partitionBy(*step).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("_last", last)
    at = lambda k: F.max(F.when((F.col("_last") - F.col(n) <= k) & (k < F.col("_last")), v))
    m = F.max("_m")
    found = inside.groupBy(*by).agg(F.array(*[at(k) for k in ranks]).alias("_x"), m.alias("_m"))
    q = [F.col("_x")[2 * i] + (F.col("_x")[2 * i + 1] - F.col("_x")[2 * i]) * (x - F.floor(x)) for i, x in enumerate(place)]
    return found.select(*(groups or []), F.array(*q).alias("q"))
