import math
from itertools import combinations
from statistics import fmean, median, stdev, variance

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotloom.operators import describe, effects, evaluate, explore, proportions, resample


def cells(spark, *rows):
    return spark.createDataFrame(list(rows), "a long, b long, c long, d long")


def test_conditional_odds_ratio(spark):
    # by the equation itself: the estimate makes the expected count the observed, the ends put 2.5 % in the tails
    row = effects.conditional_odds_ratio(cells(spark, (3, 1, 1, 3))).first()
    weights = lambda t: [math.comb(4, k) * math.comb(4, 4 - k) * t**k for k in range(5)]
    share = lambda t, keep: sum(w for k, w in enumerate(weights(t)) if keep(k)) / sum(weights(t))
    mean = sum(k * w for k, w in enumerate(weights(row.odds_ratio))) / sum(weights(row.odds_ratio))
    assert mean == pytest.approx(3) and 1 < row.odds_ratio < 9
    assert share(row.low, lambda k: k >= 3) == pytest.approx(0.025) and share(row.high, lambda k: k <= 3) == pytest.approx(0.025)
    ends = effects.conditional_odds_ratio(cells(spark, (4, 0, 1, 3), (0, 4, 3, 1), (0, 0, 1, 3))).collect()
    assert (ends[0].odds_ratio, ends[0].high) == (math.inf, math.inf) and (ends[1].odds_ratio, ends[1].low) == (0, 0) and ends[2].odds_ratio is None


def test_proportions(spark):
    z = proportions.two_proportion_z(cells(spark, (20, 80, 30, 70), (0, 5, 0, 5), (0, 0, 1, 1))).collect()
    assert z[0].z == pytest.approx(-0.1 / math.sqrt(0.25 * 0.75 * 0.02)) and z[0].p_value == pytest.approx(math.erfc(abs(z[0].z) / math.sqrt(2)))
    assert z[1].z is None and z[1].p_value is None and z[2].z is None
    b = proportions.beta_binomial(cells(spark, (0, 0, 0, 0), (3, 7, 3, 7), (20, 80, 30, 70))).collect()
    assert b[0].p_second_better == pytest.approx(0.5) and b[1].p_second_better == pytest.approx(0.5)
    rng = np.random.default_rng(1)
    assert b[2].p_second_better == pytest.approx((rng.beta(31, 71, 400_000) > rng.beta(21, 81, 400_000)).mean(), abs=0.005)
    lift = proportions.lift_interval(cells(spark, (20, 80, 30, 70)).withColumn("k", F.lit("x")), "k").first()
    assert lift.lift == pytest.approx(31 / 102 - 21 / 102, abs=0.003) and lift.low < 0.0 < lift.high
    with pytest.raises(ValueError, match="whole"):
        proportions.beta_binomial(cells(spark, (1, 1, 1, 1)), (0, 1))


def test_cohens_d_interval(spark):
    rng = np.random.default_rng(3)
    rows = [(k, "a" if k % 2 else "b", float(rng.normal(k % 2, 1))) for k in range(400)]
    row = effects.cohens_d_interval(spark.createDataFrame(rows, "id long, g string, v double"), "v", "g", "a", "b", "id", replicates=2000).first()
    a, b = ([v for _, g, v in rows if g == x] for x in "ab")
    assert row.cohens_d == pytest.approx((fmean(a) - fmean(b)) / math.sqrt((variance(a) + variance(b)) / 2))
    # the standard error of d by its large-sample formula
    assert row.se == pytest.approx(math.sqrt(4 / 400 + row.cohens_d**2 / 800), rel=0.1) and row.low < row.cohens_d < row.high and (row.replicates, row.failed) == (2000, 0)


def test_cramers_v_interval(spark):
    df = spark.range(400).select(F.when(F.col("id") < 200, "x").otherwise("y").alias("r"), F.when(F.col("id") % 200 < F.when(F.col("id") < 200, 120).otherwise(80), "p").otherwise("q").alias("c"))
    row = effects.cramers_v_interval(df, "r", "c", replicates=2000).first()
    assert row.cramers_v == pytest.approx(0.2) and row.low < 0.2 < row.high and row.se == pytest.approx(0.049, rel=0.1)
    rare = effects.cramers_v_interval(df.limit(3).union(spark.createDataFrame([("y", "q")], "r string, c string")), "r", "c", replicates=500).first()
    assert rare.failed > 0 and rare.failed + rare.replicates == 500
    with pytest.raises(ValueError, match="levels"):
        effects.cramers_v_interval(df.where("r = 'x'"), "r", "c")


@pytest.mark.parametrize("statistic", resample.STATISTICS)
def test_permutation_statistics(spark, statistic):
    a, b = [1.0, 2.0, 4.0, 9.0], [3.0, 8.0, 10.0, 12.0]
    df = spark.createDataFrame([(k, "a" if k < 4 else "b", v) for k, v in enumerate(a + b)], "id long, g string, v double")
    own = {"mean_difference": lambda x, y: fmean(x) - fmean(y), "median_difference": lambda x, y: median(x) - median(y), "welch_t": lambda x, y: (fmean(x) - fmean(y)) / math.sqrt(variance(x) / len(x) + variance(y) / len(y))}[statistic]
    every = [own([(a + b)[i] for i in c], [(a + b)[i] for i in range(8) if i not in c]) for c in combinations(range(8), 4)]
    less = sum(x <= own(a, b) + 1e-9 for x in every) / len(every)
    found = resample.permutation_auto(df, "v", "g", "a", "b", "id", statistic=statistic, alternative="less")
    assert found == {"p_value": pytest.approx(less), "exact": True, "labellings": 70}
    drawn = resample.permutation_auto(df, "v", "g", "a", "b", "id", statistic=statistic, alternative="less", method="monte-carlo", replicates=2000)
    assert not drawn["exact"] and drawn["p_value"] == pytest.approx(less, abs=0.04)


def test_permutation_warnings(spark):
    u = resample.units(spark.createDataFrame([(k, k % 2, float(k)) for k in range(6)], "id long, g long, v double"), "v", "id", "g")
    row = resample.permutation_test(u, "g", 1, 50).first()
    assert len(row.warnings) == 2
    many = resample.units(spark.range(40).selectExpr("id", "id % 2 AS g", "id * 1.0 AS v"), "v", "id", "g")
    assert resample.permutation_test(many, "g", 1, 50).first().warnings == []
    with pytest.raises(ValueError, match="unknown statistic"):
        resample.permutation_test(many, "g", 1, 50, statistic="x")


def test_normality(spark):
    men = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]  # a published example of the test
    w, p = describe.shapiro_wilk(np.array(men))
    assert (w, p) == (pytest.approx(0.78881, abs=1e-4), pytest.approx(0.0067038, abs=1e-5))
    assert describe.shapiro_wilk(np.array([1.0, 2.0, 3.0])) == (pytest.approx(1), pytest.approx(1))
    rows = [("men", float(x)) for x in men] + [("two", 1.0), ("two", 2.0), ("same", 3.0), ("same", 3.0), ("same", 3.0), ("men", None)]
    got = {r.g: r for r in describe.assess_normality(spark.createDataFrame(rows, "g string, v double"), "v", "g").collect()}
    assert got["men"].shapiro_w == pytest.approx(w) and got["men"].n == 11 and got["men"].k2 is None
    assert got["two"].shapiro_w is None and got["same"].shapiro_w is None and len(got["men"].notes) == 3
    big = describe.assess_normality(spark.range(6000).select(F.randn(1).alias("v")), "v").first()
    assert big.n == 6000 and big.shapiro_w is None and big.k2_p_value > 1e-3
    some = describe.assess_normality(spark.range(1000).select(F.exp(F.randn(1)).alias("v")), "v").first()
    assert some.shapiro_p_value < 1e-9 and some.k2_p_value < 1e-9


def test_callable_bootstrap(spark):
    df = spark.range(50).selectExpr("id * 1.0 AS v")
    drawn = [r.stat for r in resample.bootstrap_callable(df, lambda x: float(np.median(x)), 500).collect()]
    assert len(drawn) == 500 and fmean(drawn) == pytest.approx(24.5, abs=1.5) and stdev(drawn) > 1
    with pytest.raises(ValueError, match="more than 10 rows"):
        resample.bootstrap_callable(df, np.median, 5, most=10)


def test_ordered_target_statistic_with_a_null_category(spark):
    df = spark.createDataFrame([(k, None if k % 3 else "x", k % 2) for k in range(30)], "id long, c string, y int")
    for ranges in (1, 8, 1024):
        rows = evaluate.ordered_target_statistic(df, "c", "y", "id", 0.5, ranges=ranges).withColumn("h", resample.draw(42, "id")).orderBy("h", "id").collect()
        seen: dict = {}
        for r in rows:
            before = seen.setdefault(r.c, [])
            assert r.target_statistic == pytest.approx((sum(before) + 0.5) / (len(before) + 1))
            before.append(r.y)
        assert len(rows) == 30


def test_keys_with_all(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (2, 0), (2, 5), (3, None)], "k long, positions int")
    assert tuple(explore.keys_with_all(df, "k", F.col("positions") == 0).first()) == (3, 1)
