"""Descriptive statistics and normality diagnostics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi2_sf, normal_ppf
from .ranks import meet, quantiles

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
#: The modified z-score's factor, the 75 % point of the normal distribution, and its usual cut.
MAD_FACTOR, MAD_CUT, FENCE = 0.6744897501960817, 3.5, 1.5
#: Sizes for which the normality tests are defined, and from which a note is given.
SHAPIRO_RANGE, DAGOSTINO_LEAST, LARGE_SAMPLE = (3, 5000), 20, 300


def finite(value: str) -> Column:
    return F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def skewness_g1(value: str) -> Column:
    """Sample skewness with the usual bias correction; null below three values or without spread."""
    n = F.count(value)
    return F.when((n >= 3) & (F.max(value) > F.min(value)), F.skewness(value) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def kurtosis_g2(value: str) -> Column:
    """Sample excess kurtosis with the usual bias correction; null below four values or without spread."""
    n = F.count(value)
    factor = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0))
    return F.when((n >= 4) & (F.max(value) > F.min(value)), factor * ((n + 1) * F.kurtosis(value) + 6))


def describe_by_group(df: DataFrame, value: str, *groups: str, digits: int = 6) -> DataFrame:
    """Moments, quantiles, median absolute deviation and outliers of each group (of all rows without groups).

    Missing (null, NaN) and infinite values are counted apart and left out. Moments come from one pass over the rows, all
    else from a second that counts them per group and value; no group's values meet in one task (``ranks.quantiles``).
    """
    by = list(groups) or ["_all"]
    v = F.when(finite(value), F.col(value))
    rows = df.select(*([F.col(g) for g in groups] or [F.lit(0).alias("_all")]), F.col(value).alias("raw"), v.alias("v"))
    # without groups this is one aggregate, not one by a constant
    moments = (rows.groupBy(*by) if groups else rows).agg(
        F.count("*").alias("n_total"),
        F.count("v").alias("n_observed"),
        F.count_if(F.col("raw").isNull() | F.isnan("raw")).alias("n_missing"),
        F.count_if(F.abs("raw") == float("inf")).alias("n_infinite"),
        F.avg("v").alias("mean"),
        F.var_samp("v").alias("variance"),
        F.stddev_samp("v").alias("sd"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        skewness_g1("v").alias("skewness"),
        kurtosis_g2("v").alias("kurtosis"),
    )
    if not groups:
        moments = moments.withColumn("_all", F.lit(0))
    counts = rows.where("v IS NOT NULL").groupBy(*by, "v").agg(F.count("*").alias("n"))
    q = quantiles(counts, "v", "n", list(QUANTILES), by)
    centers = q.select(*by, F.col("q")[3].alias("median"), F.col("q")[2].alias("q1"), F.col("q")[4].alias("q3"), "q")
    near = meet(counts, centers, by, "median", "q1", "q3").withColumn("deviation", F.abs(F.col("v") - F.col("median")))
    mad = quantiles(near.groupBy(*by, "deviation").agg(F.sum("n").alias("n")), "deviation", "n", [0.5], by).select(*by, F.col("q")[0].alias("mad"))
    spread = F.col("q3") - F.col("q1")
    outside = (F.col("v") < F.col("q1") - FENCE * spread) | (F.col("v") > F.col("q3") + FENCE * spread)
    odd = (MAD_FACTOR * F.col("deviation") > MAD_CUT * F.col("mad")) & (F.col("mad") > 0)
    own = ["median", "q1", "q3", "q", "mad"]
    known = meet(centers, mad, by, "mad")
    far = meet(near, mad, by, "mad").groupBy(*by).agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(k) for k, c in (("n_outside_fences", outside), ("n_modified_z", odd))])
    out = meet(meet(moments, known, by, *own, how="left"), far, by, "n_outside_fences", "n_modified_z", how="left").na.fill(0, ["n_outside_fences", "n_modified_z"])
    r = lambda c: F.round(c, digits).alias(c)
    numbers = ["n_total", "n_observed", "n_missing", "n_infinite", "n_outside_fences", "n_modified_z"]
    se = F.round(F.col("sd") / F.sqrt("n_observed"), digits).alias("se")
    iqr = F.round(F.col("q3") - F.col("q1"), digits).alias("iqr")
    points = [F.round(F.col("q")[k], digits).alias(f"p{int(x * 100):02d}") for k, x in enumerate(QUANTILES)]
    return out.select(*groups, *numbers, *map(r, ["mean", "median", "variance", "sd", "min", "max", "q1", "q3", "mad", "skewness", "kurtosis"]), se, iqr, *points)


def modified_z_scores(df: DataFrame, value: str) -> DataFrame:
    """Adds ``modified_z``; all zero where the median absolute deviation is zero."""
    counts = df.where(finite(value)).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    half = lambda rows, c: quantiles(rows, c, "n", [0.5]).select(F.col("q")[0]).scalar()
    center = half(counts, "v")
    spread = half(counts.groupBy(F.abs(F.col("v") - center).alias("d")).agg(F.sum("n").alias("n")), "d")
    return df.withColumn("modified_z", F.when(spread == 0, 0.0).otherwise(MAD_FACTOR * (F.col(value) - center) / spread))


def _k2(rows: DataFrame) -> DataFrame:
    """Adds z_skewness, z_kurtosis and k2 to rows with n, g1 and g2 (population skewness and excess kurtosis); null below 20 values."""
    n, g1, g2 = F.when(F.col("n") >= DAGOSTINO_LEAST, F.col("n")).cast("double"), F.col("g1"), F.col("g2")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta2 - 1)) - 1
    u = y * F.sqrt((w2 - 1) / 2)
    z1 = F.ln(u + F.sqrt(u * u + 1)) / F.sqrt(0.5 * F.ln(w2))
    mean, var = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 3 - mean) / F.sqrt(var)
    b1 = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b1 * (2 / b1 + F.sqrt(1 + 4 / (b1 * b1)))
    base = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - F.signum(base) * F.pow(F.abs(base), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    return rows.withColumn("z_skewness", z1).withColumn("z_kurtosis", z2).withColumn("k2", z1 * z1 + z2 * z2)


def dagostino_k2(df: DataFrame, value: str) -> DataFrame:
    """D'Agostino and Pearson's omnibus test from two moments; no row below 20 values."""
    rows = df.where(finite(value)).agg(F.count("*").alias("n"), F.skewness(value).alias("g1"), F.kurtosis(value).alias("g2"))
    return _k2(rows).where(F.col("n") >= DAGOSTINO_LEAST).select("n", "z_skewness", "z_kurtosis", "k2", chi2_sf(F.col("k2"), 2).alias("p_value"))


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and its p-value by Royston's approximation, of 3 to 5,000 values that aren't all equal."""
    x, n = np.sort(np.asarray(values, float)), len(values)
    m = np.array([normal_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, total = 1 / np.sqrt(n), float(m @ m)
    # fixed values: coefficients of the approximation, highest power first
    last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / np.sqrt(total)], u)
    next_ = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / np.sqrt(total)], u)
    if n == 3:
        a = np.array([-1, 0, 1]) / np.sqrt(2)
    else:
        ends = [last] if n <= 5 else [last, next_]
        k = len(ends)
        phi = (total - 2 * float(m[-k:] @ m[-k:])) / (1 - 2 * float(np.dot(ends, ends)))
        a = m / np.sqrt(phi)
        a[-k:], a[:k] = ends[::-1], [-e for e in ends]
    w = min(1.0, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, 6 / np.pi * (np.arcsin(np.sqrt(w)) - np.arcsin(np.sqrt(0.75))))
    # fixed values: mean and logarithm of the deviation of the transformed statistic
    if n <= 11:
        gamma = 0.459 * n - 2.273
        tail = gamma - np.log1p(-w) if w < 1 else np.inf
        if tail <= 0:
            return w, 0.0
        y = -np.log(tail)
        mean, log_sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n)
    else:
        y, log_n = (np.log1p(-w) if w < 1 else -np.inf), np.log(n)
        mean, log_sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], log_n), np.polyval([0.0030302, -0.082676, -0.4803], log_n)
    return w, 0.5 * math.erfc((y - mean) / math.exp(log_sd) / math.sqrt(2))


def assess_normality(df: DataFrame, value: str, *groups: str) -> DataFrame:
    """A row per group (one without groups): moments, both normality tests where they apply, and notes; never a verdict.

    Shapiro and Wilk's test is of 3 to 5,000 values, so a group that is sent whole to a task is at most as large.
    """
    by = F.struct(*[F.col(g) for g in groups]) if groups else F.lit(0)
    rows = df.where(finite(value)).select(by.alias("_g"), F.col(value).cast("double").alias("v"))
    stats = rows.groupBy("_g").agg(F.count("*").alias("n"), F.skewness("v").alias("g1"), F.kurtosis("v").alias("g2"), skewness_g1("v").alias("skewness"), kurtosis_g2("v").alias("kurtosis"), (F.max("v") > F.min("v")).alias("spread"))
    least, most = SHAPIRO_RANGE
    keyed = stats.withColumn("_k", F.to_json("_g") if groups else F.lit("0"))
    enough = keyed.where(F.col("n").between(least, most) & F.col("spread")).select(F.col("_k").alias("_k2"))
    whole = rows.select((F.to_json("_g") if groups else F.lit("0")).alias("_k"), "v").join(enough, F.col("_k") == F.col("_k2"), "left_semi")

    def test(group: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_wilk(group["v"].to_numpy())
        return pd.DataFrame({"_k3": [group["_k"].iloc[0]], "shapiro_w": [w], "shapiro_p_value": [p]})

    tested = whole.groupBy("_k").applyInPandas(test, "_k3 string, shapiro_w double, shapiro_p_value double")
    out = _k2(keyed).join(tested, F.col("_k") == F.col("_k3"), "left")
    n = F.col("n")
    notes = F.array_compact(F.array(
        F.when(~n.between(least, most), F.lit("Shapiro-Wilk needs 3 to 5000 values")),
        F.when(n < DAGOSTINO_LEAST, F.lit("D'Agostino-Pearson needs 20 values")),
        F.when(n >= LARGE_SAMPLE, F.lit("many values: departures too small to matter are detected")),
        F.when(n < DAGOSTINO_LEAST, F.lit("few values: a large p-value is no evidence of normality")),
        F.lit("of the values, not of a statistic or of residuals"),
    ))
    return out.select(*[F.col(f"_g.{g}").alias(g) for g in groups], "n", "skewness", "kurtosis", "shapiro_w", "shapiro_p_value", "k2", chi2_sf(F.col("k2"), 2).alias("k2_p_value"), notes.alias("notes"))
