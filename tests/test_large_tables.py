from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotloom.operators import exact, hypothesis


def test_kolmogorov_law():
    # fixed values: published probabilities P(D < d) of n values
    for n, d, p in ((2000, 0.04, 0.99676943191713676985), (16000, 0.016, 0.99945234913828052085)):
        assert 1 - exact.kolmogorov_upper(d, n) == pytest.approx(p, abs=2e-8)


def kolmogorov_exact(d, n):
    """P(D < d) by the power of a matrix of transition weights."""
    k = int(np.ceil(n * d))
    h, m = k - n * d, 2 * k - 1
    t = np.tril(np.ones((m, m)), 1) * (np.subtract.outer(np.arange(m), np.arange(m)) >= -1)
    for i in range(m):
        t[i, 0] -= h ** (i + 1)
        t[m - 1, i] -= h ** (m - i)
    t[m - 1, 0] += (2 * h - 1) ** m if 2 * h - 1 > 0 else 0
    fact = np.cumprod(np.append(1.0, np.arange(1, m + 1)))
    for i in range(m):
        for j in range(m):
            if i - j + 1 > 0:
                t[i, j] /= fact[i - j + 1]
    q, out, power = t / n, np.eye(m), n
    scale = np.exp((np.sum(np.log(np.arange(1, n + 1)))) / n)
    q = q * scale
    while power:
        if power & 1:
            out = out @ q
        q, power = q @ q, power >> 1
    return out[k - 1, k - 1]


@pytest.mark.parametrize("n, d", [(100, 0.06), (100, 0.11), (400, 0.04), (400, 0.07), (400, 0.1)])
def test_kolmogorov_law_like_the_matrix(n, d):
    assert 1 - exact.kolmogorov_upper(d, n) == pytest.approx(kolmogorov_exact(d, n), abs=2 / n**2)


def test_ks_beyond_the_exact_range(spark, monkeypatch):
    rows = spark.range(9000).select((F.col("id") % 3 == 0).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(10**9)) + 2 * 10**7 * (F.col("id") % 3 == 0).cast("int")).cast("double").alias("v"))
    whole = hypothesis.kolmogorov_smirnov(rows, "v", "g", True, False).first()
    monkeypatch.setattr(exact, "KS_MOST", 100)
    law = hypothesis.kolmogorov_smirnov(rows, "v", "g", True, False).first()
    assert (whole.method, law.method) == ("exact", "asymptotic") and law.p_value == pytest.approx(whole.p_value, rel=0.03)


def plain_chi2(table, yates):
    e = np.outer(table.sum(1), table.sum(0)) / table.sum()
    off = np.abs(table - e)
    return ((off - (np.minimum(0.5, off) if yates else 0)) ** 2 / e).sum(), e.min()


@pytest.mark.parametrize("table", [[[3, 0], [0, 9]], [[30, 0], [12, 9]], [[5, 6], [7, 80]], [[5, 0, 2], [0, 0, 9], [1, 4, 0]], [[4, 5, 6]]])
def test_sparse_chi_square(spark, table):
    t = np.array(table)
    rows = [(f"r{i}", j) for (i, j), n in np.ndenumerate(t) for _ in range(n)] + [(None, 1), ("r0", None)]
    for correction in (True, False):
        got = hypothesis.chi_square(spark.createDataFrame(rows, "r string, c long"), "r", "c", correction=correction).first()
        want, least = plain_chi2(t, correction and t.shape == (2, 2))
        assert got.chi2 == pytest.approx(want, abs=1e-9) and got.dof == (t.shape[0] - 1) * (t.shape[1] - 1)
        assert any("below 5" in w for w in got.warnings) == (least < 5)


def test_many_levels(spark):
    """Cells that hold rows are few beside 20,000 by 20,000 levels."""
    rows = spark.range(60_000).select((F.col("id") % 20_000).alias("r"), ((F.col("id") * 7 + F.col("id") % 3) % 20_000).alias("c"))
    got = hypothesis.chi_square(rows, "r", "c").first()
    cells = rows.groupBy("r", "c").count().toPandas()
    a, b = cells.groupby("r")["count"].sum(), cells.groupby("c")["count"].sum()
    e = cells["r"].map(a) * cells["c"].map(b) / 60_000
    assert got.dof == (len(a) - 1) * (len(b) - 1) and got.chi2 == pytest.approx((cells["count"] ** 2 / e).sum() - 60_000, rel=1e-9)


@pytest.mark.parametrize("alternative", ["two-sided", "less", "greater"])
def test_fisher_like_all_tables(spark, alternative):
    rng = np.random.default_rng(3)
    tables = [tuple(map(int, rng.integers(0, m, 4))) for m in (3, 6, 12, 40, 200) for _ in range(12)] + [(0, 0, 0, 0), (5, 0, 0, 0), (3, 3, 3, 3), (0, 10, 10, 0)]
    got = hypothesis.fisher_exact(spark.createDataFrame([(k, *t) for k, t in enumerate(tables)], "k long, a long, b long, c long, d long"), alternative).collect()
    for r in got:
        a, b, c, d = tables[r.k]
        ways = {k: comb(a + b, k) * comb(c + d, a + c - k) for k in range(max(0, a - d), min(a + b, a + c) + 1)}
        keep = {"two-sided": lambda k: ways[k] <= ways[a] * (1 + 1e-7), "less": lambda k: k <= a, "greater": lambda k: k >= a}[alternative]
        assert r.p_value == pytest.approx(sum(w for k, w in ways.items() if keep(k)) / sum(ways.values()), rel=1e-6), (tables[r.k], alternative)


def test_fisher_of_huge_margins(spark):
    rows = spark.createDataFrame([(50_000_000, 50_000_000, 49_990_000, 50_010_000), (50_000_000, 50_000_000, 49_900_000, 50_100_000)], "a long, b long, c long, d long")
    near, far = (r.p_value for r in hypothesis.fisher_exact(rows).collect())
    # the normal approximation is close for margins of 10^8
    assert near == pytest.approx(0.1573, abs=0.001) and far < 1e-40


def test_warnings_of_many_groups(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 4.0), ("b", 7.0), ("b", float("nan"))], "g string, v double")
    ranks = hypothesis.kruskal_wallis(rows, "v", "g").first().warnings
    assert [any(w in x for x in ranks) for w in ("left out", "two groups", "ties")] == [True, True, True]
    means = hypothesis.welch_anova(hypothesis.group_statistics(rows, "v", "g")).first().warnings
    assert any("two groups" in x for x in means) and not any("ties" in x for x in means)


def test_own_goals_are_reconciled(spark):
    from shotloom.operators import explore

    matches = spark.createDataFrame([(1, 3), (2, 2)], "match_id long, total_goals long")
    shots = spark.createDataFrame([(1, True, False), (1, True, False), (2, True, False), (2, True, True)], "match_id long, is_goal boolean, is_shootout boolean")
    events = spark.createDataFrame([("Own Goal For",), ("Own Goal Against",), ("Pass",)], "type string")
    assert tuple(explore.reconciliation(matches, shots).first()) == (5, 3, 2)
    assert tuple(explore.reconciliation(matches, shots, events).first()) == (5, 3, 2, 1, 1)
