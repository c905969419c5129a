"""Comparing two proportions: the pooled z test and the Beta-Binomial comparison of two variants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import by_alternative, lgamma, normal_sf


def two_proportion_z(tables: DataFrame, alternative: str = "two-sided") -> DataFrame:
    """tables: rows with cells a, b, c, d (hits and misses of two groups). Adds both rates, ``z`` and ``p_value``; null without variance."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n1, n2 = a + b, c + d
    pooled = F.try_divide(a + c, n1 + n2)
    p1, p2 = F.try_divide(a, n1), F.try_divide(c, n2)
    z = F.try_divide(p1 - p2, F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2))))
    rows = tables.withColumn("rate_1", p1).withColumn("rate_2", p2).withColumn("z", z)
    z = F.col("z")
    return rows.withColumn("p_value", F.when(z.isNotNull(), by_alternative(normal_sf(-z), normal_sf(z), alternative)))


def beta_binomial(tables: DataFrame, prior: tuple[int, int] = (1, 1)) -> DataFrame:
    """Adds ``posterior_1``, ``posterior_2`` (means) and ``p_second_better``, P(p2 > p1), for whole-number priors.

    The probability is a closed sum of one term for each of the second group's posterior hits, added in logarithms.
    """
    alpha, beta = (F.lit(float(x)) for x in prior)
    if not all(float(x).is_integer() and x >= 1 for x in prior):
        raise ValueError("the prior's parameters must be whole numbers of at least 1")
    a1, b1, a2, b2 = (F.col(x).cast("double") + p for x, p in zip("abcd", (alpha, beta, alpha, beta), strict=True))
    log_beta = lambda x, y: lgamma(x) + lgamma(y) - lgamma(x + y)
    at = F.transform(F.array(F.struct(a1.alias("a1"), b1.alias("b1"), a2.alias("a2"), b2.alias("b2"))), lambda v: F.aggregate(
        F.sequence(F.lit(0), v["a2"].cast("int") - 1),
        F.lit(0.0),
        lambda s, i: s + F.exp(log_beta(v["a1"] + i, v["b1"] + v["b2"]) - F.ln(v["b2"] + i) - log_beta(i + F.lit(1.0), v["b2"]) - log_beta(v["a1"], v["b1"])),
    ))[0]
    return tables.withColumn("posterior_1", a1 / (a1 + b1)).withColumn("posterior_2", a2 / (a2 + b2)).withColumn("p_second_better", at)


def lift_interval(tables: DataFrame, key: str, prior: tuple[float, float] = (1, 1), draws: int = 20_000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Adds ``lift`` (posterior mean of p2 - p1) and the ``low`` and ``high`` ends of its interval, from seeded draws for each row's key."""
    tail = (1 - confidence) / 2

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, a, b, c, d in f[[key, "a", "b", "c", "d"]].itertuples(index=False):
                rng = np.random.default_rng([seed, *str(k).encode()])
                diff = rng.beta(prior[0] + c, prior[1] + d, draws) - rng.beta(prior[0] + a, prior[1] + b, draws)
                out.append((diff.mean(), *np.quantile(diff, [tail, 1 - tail])))
            yield f.assign(**{n: [o[i] for o in out] for i, n in enumerate(("lift", "low", "high"))})

    ddl = ", ".join(f"`{c}` {t}" for c, t in tables.dtypes)
    return tables.mapInPandas(run, f"{ddl}, lift double, low double, high double")
