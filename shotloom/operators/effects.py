"""Effect sizes from the same sufficient statistics as the tests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import lgamma, normal_ppf
from . import resample
from .describe import finite


def cohens_d(samples: DataFrame) -> DataFrame:
    """d by the pooled deviation, and Hedges' g with the exact small-sample factor."""
    df = (F.col("n1") + F.col("n2") - 2).cast("double")
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / df)
    d = F.try_divide(F.col("m1") - F.col("m2"), pooled)
    factor = F.exp(lgamma(df / 2) - lgamma((df - 1) / 2)) / F.sqrt(df / 2)
    return samples.select("n1", "n2", d.alias("cohens_d"), (d * factor).alias("hedges_g"))


def cohens_d_interval(df: DataFrame, value: str, group: str, first, second, key: str, *, replicates: int = resample.REPLICATES, seed: int = 42, confidence: float = 0.95, bias_correction: bool = False) -> DataFrame:
    """d (or g) with the percentile interval of a bootstrap of rows inside each group; resamples without spread are counted as failed."""
    from .hypothesis import two_samples

    own = df.where(F.col(group).isin(first, second) & finite(value))
    sums = resample.bootstrap_row_sums(own, value, key, replicates, seed, side=(F.col(group) == second).cast("int"))
    of = lambda c, k: F.max(F.when(F.col("side") == k - 1, F.col(c)))
    both = sums.groupBy("replicate").agg(*[of(c, k).alias(f"{name}{k}") for k in (1, 2) for c, name in (("n", "n"), ("s1", "s"), ("s2", "q"))]).where("n1 > 0 AND n2 > 0")
    for k in (1, 2):
        both = both.withColumn(f"m{k}", F.try_divide(f"s{k}", f"n{k}")).withColumn(f"v{k}", F.greatest(F.lit(0.0), F.try_divide(F.col(f"q{k}") - F.col(f"s{k}") * F.col(f"m{k}"), F.col(f"n{k}") - 1)))
    name = "hedges_g" if bias_correction else "cohens_d"
    drawn = cohens_d(both).select(F.col(name).alias("x"))
    tail = (1 - confidence) / 2
    s = drawn.agg(F.count("x").alias("replicates"), F.count_if(F.col("x").isNull()).alias("failed"), F.stddev_samp("x").alias("se"), F.percentile("x", F.array(F.lit(tail), F.lit(1 - tail))).alias("ci"))
    estimate = cohens_d(two_samples(df, value, group, first, second)).select(name).scalar()
    return s.select(estimate.alias(name), "se", F.col("ci")[0].alias("low"), F.col("ci")[1].alias("high"), "replicates", "failed")


def superiority(mann_whitney: DataFrame) -> DataFrame:
    """The probability of superiority and the rank-biserial correlation, of a Mann-Whitney row."""
    return mann_whitney.select("superiority", (2 * F.col("superiority") - 1).alias("rank_biserial"))


def odds_ratio(tables: DataFrame, confidence: float = 0.95) -> DataFrame:
    """ad / bc with the log-Wald interval; cells a, b, c, d."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    z = normal_ppf((1 + confidence) / 2)
    rows = tables.withColumn("odds_ratio", F.try_divide(a * d, b * c))
    half = z * F.sqrt(F.try_divide(F.lit(1.0), a) + F.try_divide(F.lit(1.0), b) + F.try_divide(F.lit(1.0), c) + F.try_divide(F.lit(1.0), d))
    return rows.withColumn("low", F.exp(F.ln("odds_ratio") - half)).withColumn("high", F.exp(F.ln("odds_ratio") + half))


def noncentral_odds(a: int, b: int, c: int, d: int, confidence: float) -> tuple[float, float, float]:
    """The conditional maximum-likelihood odds ratio of one table and its exact interval, by bisection on its logarithm."""
    k = np.arange(max(0, a - d), min(a + b, a + c) + 1)
    if len(k) == 1:
        return float("nan"), 0.0, float("inf")
    steps = np.log((a + b - k[:-1]) * (a + c - k[:-1]) / ((k[:-1] + 1.0) * (d - a + k[:-1] + 1)))
    weight = np.concatenate([[0.0], np.cumsum(steps)])

    def share(t: float, of) -> float:
        w = weight + t * k
        p = np.exp(w - w.max())
        return float((of * p).sum() / p.sum())

    def solve(of, want: float) -> float:
        low, high = -1.0, 1.0
        while share(low, of) > want and low > -700:
            low *= 2
        while share(high, of) < want and high < 700:
            high *= 2
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if share(mid, of) < want else (low, mid)
        return float(np.exp((low + high) / 2))

    tail = (1 - confidence) / 2
    estimate = 0.0 if a == k[0] else float("inf") if a == k[-1] else solve(k, a)
    low = 0.0 if a == k[0] else solve((k >= a) * 1.0, tail)
    high = float("inf") if a == k[-1] else solve((k > a) * 1.0, 1 - tail)
    return estimate, low, high


def conditional_odds_ratio(tables: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Adds the conditional odds ratio and its exact interval to rows with cells a, b, c, d; null where a margin is empty.

    Like tables are solved once. A table takes time and memory in its smallest margin, which is the number of its terms.
    """
    from .hypothesis import once_per_table

    return once_per_table(tables, lambda own: _conditional_odds_ratio(own, confidence), "odds_ratio", "low", "high")


def _conditional_odds_ratio(tables: DataFrame, confidence: float) -> DataFrame:
    ddl = ", ".join(f"`{c}` {t}" for c, t in tables.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [noncentral_odds(*map(int, r), confidence) for r in f[["a", "b", "c", "d"]].itertuples(index=False)]
            yield f.assign(**{n: [x[i] for x in found] for i, n in enumerate(("odds_ratio", "low", "high"))})

    rows = tables.mapInPandas(run, f"{ddl}, odds_ratio double, low double, high double")
    return rows.withColumn("odds_ratio", F.when(~F.isnan("odds_ratio"), F.col("odds_ratio")))


def risk_difference(tables: DataFrame, confidence: float = 0.95) -> DataFrame:
    """a/(a+b) - c/(c+d) with Newcombe's interval of two Wilson scores."""
    z = normal_ppf((1 + confidence) / 2)

    def wilson(hit, n):
        p, center = hit / n, (hit / n + z * z / (2 * n)) / (1 + z * z / n)
        half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
        return p, center - half, center + half

    (p1, l1, u1), (p2, l2, u2) = (wilson(F.col(x).cast("double"), (F.col(x) + F.col(y)).cast("double")) for x, y in (("a", "b"), ("c", "d")))
    sq = lambda x: x * x
    low, high = p1 - p2 - F.sqrt(sq(p1 - l1) + sq(u2 - p2)), p1 - p2 + F.sqrt(sq(u1 - p1) + sq(p2 - l2))
    return tables.withColumn("risk_difference", p1 - p2).withColumn("low", low).withColumn("high", high)


def cramers_v(chi: DataFrame, *, bias_correction: bool = False) -> DataFrame:
    """From a chi-square row (its uncorrected statistic); Bergsma's correction if asked for."""
    n, r, c = F.col("n").cast("double"), F.col("r").cast("double"), F.col("c").cast("double")
    phi = F.col("chi2_plain") / n
    if bias_correction:
        phi = F.greatest(F.lit(0.0), phi - r * c / (n - 1))
        r, c = r - r * r / (n - 1), c - c * c / (n - 1)
    return chi.select("n", F.sqrt(phi / F.least(r, c)).alias("cramers_v"))


def cramers_v_interval(df: DataFrame, row: str, column: str, *, replicates: int = resample.REPLICATES, seed: int = 42, confidence: float = 0.95, bias_correction: bool = False, most_cells: int = 10_000) -> DataFrame:
    """V of two label columns with the percentile interval of a bootstrap of rows.

    A resample of rows is a multinomial draw of the cells' counts, so only the cells (an error beyond ``most_cells``) reach the
    tasks. Resamples that lose a level of either column count as failed.
    """
    pairs = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    cells = pairs.groupBy(row, column).agg(F.count("*").alias("n")).limit(most_cells + 1).collect()
    if len(cells) > most_cells:
        raise ValueError(f"more than {most_cells} pairs of levels")
    cells.sort(key=lambda r: (str(r[0]), str(r[1])))
    levels = [{x: k for k, x in enumerate(sorted({r[i] for r in cells}, key=str))} for i in (0, 1)]
    counts = np.zeros((len(levels[0]), len(levels[1])), dtype=np.int64)
    for r in cells:
        counts[levels[0][r[0]], levels[1][r[1]]] = r["n"]
    if min(counts.shape) < 2:
        raise ValueError("each column needs two levels or more")

    def statistic(t: np.ndarray) -> float:
        a, b, n = t.sum(1), t.sum(0), t.sum()
        if not (a.all() and b.all()):
            return float("nan")
        e = np.outer(a, b) / n
        phi, (r, c) = ((t - e) ** 2 / e).sum() / n, (x - 1.0 for x in t.shape)
        if bias_correction:
            phi, r, c = max(0.0, phi - r * c / (n - 1)), r - r * r / (n - 1), c - c * c / (n - 1)
        return float(np.sqrt(phi / min(r, c)))

    total, shares = int(counts.sum()), (counts / counts.sum()).ravel()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            drawn = [statistic(np.random.default_rng([seed, int(r)]).multinomial(total, shares).reshape(counts.shape)) for r in f["id"]]
            yield pd.DataFrame({"x": drawn})

    x = df.sparkSession.range(1, replicates + 1).mapInPandas(run, "x double").select(F.when(~F.isnan("x"), F.col("x")).alias("x"))
    tail = (1 - confidence) / 2
    s = x.agg(F.count("x").alias("replicates"), F.count_if(F.col("x").isNull()).alias("failed"), F.stddev_samp("x").alias("se"), F.percentile("x", F.array(F.lit(tail), F.lit(1 - tail))).alias("ci"))
    return s.select(F.lit(statistic(counts)).alias("cramers_v"), "se", F.col("ci")[0].alias("low"), F.col("ci")[1].alias("high"), "replicates", "failed")
