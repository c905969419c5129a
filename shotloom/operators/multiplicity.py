"""Corrections of families of p-values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import RANGES, running_sums


def adjust(family: DataFrame, p: str = "p_value", key: str = "label", family_key: str | None = None) -> DataFrame:
    """Adds ``bonferroni`` and ``benjamini_hochberg``; a p-value that is null or outside [0, 1] is an error.

    With ``family_key`` many families are corrected at once, each a small list by nature. One family of any size is corrected
    by its distinct p-values, whose counts and least steps are taken in ranges.
    """
    checked = F.when(F.col(p).between(0, 1), F.col(p)).otherwise(F.raise_error(F.lit("p-values must lie in [0, 1]")))
    family = family.withColumn(p, checked)
    if not family_key:
        return _adjust_one(family, p)
    whole, ordered = Window.partitionBy(family_key), Window.partitionBy(family_key).orderBy(p, key)
    rows = family.withColumn("_m", F.count("*").over(whole)).withColumn("_k", F.row_number().over(ordered))
    step_up = F.min(F.col(p) * F.col("_m") / F.col("_k")).over(Window.partitionBy(family_key).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("bonferroni", F.least(F.lit(1.0), F.col(p) * F.col("_m"))).withColumn("benjamini_hochberg", F.least(F.lit(1.0), step_up))
    return rows.drop("_m", "_k")


def _adjust_one(family: DataFrame, p: str) -> DataFrame:
    """The last of like p-values has the least step, so a step belongs to a distinct p-value and the number of tests up to it."""
    per = running_sums(family.groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n")), "_p", {"_k": "_n"})
    per = per.withColumn("_m", family.agg(F.count("*")).scalar()).withColumn("_step", F.col("_p") * F.col("_m") / F.col("_k"))
    # ranges by the number of tests up to a value: those above have their least step as a row each
    per = per.withColumn("_r", F.floor(F.col("_k") * RANGES / (F.col("_m") + 1)))
    above = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    ranges = per.groupBy("_r").agg(F.min("_step").alias("_least")).select("_r", F.min("_least").over(above).alias("_above"))
    inside = Window.partitionBy("_r").orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    per = per.join(F.broadcast(ranges), "_r").select("_p", "_m", F.least(F.lit(1.0), F.min("_step").over(inside), F.col("_above")).alias("benjamini_hochberg"))
    rows = family.join(per, F.col(p) == F.col("_p"))
    return rows.select(*family.columns, F.least(F.lit(1.0), F.col(p) * F.col("_m")).alias("bonferroni"), "benjamini_hochberg")


def family_summary(adjusted: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """Rejections before and after each correction, and what chance alone would give."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    n = F.count("*")
    return adjusted.agg(n.alias("tests"), *[F.count_if(F.col(c) <= alpha).alias(f"rejected_{k}") for k, c in (("raw", p), ("bonferroni", "bonferroni"), ("bh", "benjamini_hochberg"))], (n * alpha).alias("expected_false"), (1 - F.pow(F.lit(1 - alpha), n)).alias("familywise"))
