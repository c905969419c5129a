"""Exploratory aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ordinal, running_sums

R = 6
#: Fixed value: the event of an own goal, on the side that gains it.
OWN_GOAL = "Own Goal For"


def _r(c: Column, digits: int = R) -> Column:
    return F.round(c, digits)


def share_table(df: DataFrame, column: str) -> DataFrame:
    """Counts of each value, nulls too, and their share; the total is one row more, not a window over all rows."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", _r(F.col("n") / df.agg(F.count("*")).scalar()))


def rate_table(df: DataFrame, column: str, flag: str = "is_goal") -> DataFrame:
    rows = df.groupBy(column).agg(F.count("*").alias("shots"), F.count_if(flag).alias("goals"))
    rows = rows.withColumn("goal_rate", _r(F.try_divide("goals", "shots")))
    return rows.withColumn("share_of_shots", _r(F.col("shots") * 100 / df.agg(F.count("*")).scalar()))


def flag_table(df: DataFrame, flags: list[str], target: str = "is_goal") -> DataFrame:
    """A row per boolean column: how often it is true, and the target's rate where it is and where it isn't."""
    aggs = [F.count("*").alias("n")]
    for f in flags:
        t, y = F.col(f), F.col(target).cast("double")
        aggs.append(F.struct(F.count_if(t).alias("true_count"), F.avg(F.when(t, y)).alias("rate_true"), F.avg(F.when(~t, y)).alias("rate_false")).alias(f))
    rows = df.agg(*aggs).unpivot("n", flags, "flag", "v")
    return rows.select("flag", "v.true_count", _r(F.col("v.true_count") / F.col("n")).alias("share"), _r(F.col("v.rate_true")).alias("rate_true"), _r(F.col("v.rate_false")).alias("rate_false"))


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of two columns, a column per value of the second, absent cells 0."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def crosstab_margins(df: DataFrame, row: str, column: str) -> DataFrame:
    """Long counts with both margins and the total, 'All' standing for any value."""
    cube = df.cube(row, column).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    name = lambda c, bit: F.when(F.col("g").bitwiseAND(F.lit(bit)) != 0, "All").otherwise(F.col(c).cast("string"))
    return cube.select(name(row, 2).alias(row), name(column, 1).alias(column), "n")


def complete_table(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, n) of every pair of levels, empty cells 0: the observed cells spread over the levels' list."""
    cells = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.count("*").alias("n"))
    levels = cells.agg(F.array_sort(F.collect_set(column))).scalar()
    per_row = cells.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(column, "n"))).alias("m"))
    return per_row.select(row, "m", F.explode(levels).alias(column)).select(row, column, F.coalesce(F.try_element_at("m", F.col(column)), F.lit(0)).alias("n"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal bins; the last is closed on the right, values outside are left out."""
    width = (high - low) / bins
    inside = df.where(F.col(column).between(low, high))
    k = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("long")
    return inside.groupBy(k.alias("bin")).agg(F.count("*").alias("n")).withColumn("left_edge", F.col("bin") * width + low)


def grid_rates(df: DataFrame, x: str, y: str, flag: str, cell: float = 4.0, x0: float = 60.0, x1: float = 120.0, y1: float = 80.0, least: int = 10) -> DataFrame:
    """Rates of square cells; null where a cell has fewer than ``least`` rows."""
    inside = df.where(F.col(x).between(x0, x1) & F.col(y).between(0, y1))
    at = lambda c, low, high: F.least(F.floor((F.col(c) - low) / cell), F.lit(int((high - low) / cell) - 1)).cast("long")
    rows = inside.groupBy(at(x, x0, x1).alias("cx"), at(y, 0.0, y1).alias("cy")).agg(F.count("*").alias("n"), F.avg(F.col(flag).cast("double")).alias("rate"))
    return rows.withColumn("rate", F.when(F.col("n") >= least, _r(F.col("rate"))))


def calibration_bins(df: DataFrame, score: str, flag: str, edges: tuple[float, ...] = (0.0, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0)) -> DataFrame:
    """Right-closed bins; a score at the lowest edge or outside belongs to none."""
    at = F.lit(None).cast("long")
    for k in range(len(edges) - 2, -1, -1):
        at = F.when((F.col(score) > edges[k]) & (F.col(score) <= edges[k + 1]), F.lit(k).cast("long")).otherwise(at)
    rows = df.withColumn("bin", at).where("bin IS NOT NULL").groupBy("bin")
    return rows.agg(F.count("*").alias("n"), _r(F.avg(score)).alias("mean_score"), _r(F.avg(F.col(flag).cast("double"))).alias("rate"))


def top_share(groups: DataFrame, amount: str, key: str, part: int = 20) -> DataFrame:
    """The share of the amount that the largest 1/part of the groups hold. groups: a row per key."""
    n = groups.agg(F.expr(f"count(*) div {part}")).scalar()
    ranked = ordinal(groups.withColumn("_down", -F.col(amount)), ["_down", key], name="_k").withColumn("_n", n)
    return ranked.agg(F.sum(F.when(F.col("_k") < F.col("_n"), F.col(amount)).otherwise(0)).alias("top"), F.sum(amount).alias("total")).select("top", "total", _r(F.try_divide("top", "total")).alias("share"))


def aggregate_of_counts(df: DataFrame, key: str) -> DataFrame:
    """How many rows keys have: number of keys, least, most and mean."""
    return df.groupBy(key).agg(F.count("*").alias("n")).agg(F.count("*").alias("keys"), F.min("n").alias("least"), F.max("n").alias("most"), _r(F.avg("n")).alias("mean"))


def describe_counts(counts: DataFrame, column: str) -> DataFrame:
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = counts.agg(F.count(column).alias("count"), _r(F.avg(column)).alias("mean"), _r(F.stddev_samp(column)).alias("std"), F.min(column).alias("min"), q.alias("q"), F.max(column).alias("max"))
    return rows.select("count", "mean", "std", "min", *[_r(F.col("q")[k]).alias(f"p{p}") for k, p in enumerate((25, 50, 75))], "max")


def located_range(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("located"), *[_r(f(c)).alias(f"{n}_{c}") for c in (x, y) for n, f in (("min", F.min), ("max", F.max))])


def ecdf_gap(df: DataFrame, value: str, group: str, first, second) -> DataFrame:
    """Where two samples' empirical distributions are farthest apart: per-value counts, summed over values in order."""
    own = df.where(F.col(group).isin(first, second) & F.col(value).isNotNull())
    per = own.groupBy(value).agg(*[F.count_if(F.col(group) == g).alias(c) for c, g in (("a", first), ("b", second))])
    sums = per.agg(F.struct(F.sum("a").alias("a"), F.sum("b").alias("b"))).scalar()
    rows = running_sums(per, value, {"ca": "a", "cb": "b"}).withColumn("n", sums)
    gap = F.col("ca") / F.col("n.a") - F.col("cb") / F.col("n.b")
    return rows.select(value, gap.alias("gap")).agg(_r(F.max(F.abs("gap"))).alias("d"), _r(F.max("gap")).alias("d_plus"), _r(F.max(-F.col("gap"))).alias("d_minus"))


def codes(df: DataFrame, column: str) -> DataFrame:
    """Distinct values numbered from 0 in their order."""
    return ordinal(df.select(column).distinct(), [column], name="code")


def reconciliation(matches: DataFrame, shots: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Goals of shots against goals of scores: what is left are own goals, which are counted too where ``events`` are given."""
    goals = shots.where("NOT is_shootout").agg(F.count_if("is_goal")).scalar()
    rows = matches.agg(F.sum("total_goals").cast("long").alias("score_goals"))
    rows = rows.select("score_goals", goals.alias("shot_goals"), (F.col("score_goals") - goals).alias("difference"))
    if events is None:
        return rows
    # each is recorded for the team that gains and for the one that concedes
    own = events.where(F.col("type") == OWN_GOAL).agg(F.count("*")).scalar()
    return rows.withColumn("own_goals", own).withColumn("unexplained", F.col("difference") - F.col("own_goals"))


def spanning(df: DataFrame, key: str, column: str) -> DataFrame:
    """Keys with more than one value of a column."""
    return df.groupBy(key).agg(F.countDistinct(column).alias("levels")).where("levels > 1")


def keys_with_all(df: DataFrame, key: str, condition: Column) -> DataFrame:
    """One row: how many keys there are, and how many whose every row meets the condition; a null does not meet it."""
    per = df.groupBy(key).agg(F.bool_and(F.coalesce(condition, F.lit(False))).alias("every"))
    return per.agg(F.count("*").alias("keys"), F.count_if("every").alias("keys_with_all"))


def phase_means(df: DataFrame, value: str, keys: list[str], phase: str, first, second, least: int = 5) -> DataFrame:
    """Mean and size of a value in two phases, side by side for each key; keys with ``least`` values or more in both."""
    out = [f(F.when(F.col(phase) == g, F.col(value))).alias(f"{n}_{k}") for k, g in ((1, first), (2, second)) for n, f in (("mean", F.avg), ("n", F.count))]
    return df.groupBy(*keys).agg(*out).where((F.col("n_1") >= least) & (F.col("n_2") >= least))
