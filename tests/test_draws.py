"""Draws with replacement by counts of values: the multinomial law, and work that grows with the values, not with the rows."""

import math
from statistics import fmean, pstdev

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotloom.functions import draws
from shotloom.operators import effects, resample


@pytest.mark.parametrize("mean", [0.01, 0.3, 1, 6, 300, 3000])
def test_counts_are_multinomial(monkeypatch, mean):
    monkeypatch.setattr(draws, "TILE", 100)
    cells, n = 512, max(1, int(512 * mean))
    one = draws.Cells(np.column_stack([np.ones(cells), np.arange(cells) < 3, np.arange(cells) >= 3, np.arange(cells) == 500]), n)
    assert (one.table is not None) == (1 / 64 < mean <= 1024)
    got = np.concatenate([one.sums(np.random.default_rng([7, i]), np.full(32, n)) for i in range(400)])
    assert (got[:, 0] == n).all() and (got[:, 1] + got[:, 2] == n).all()
    for column, p in ((1, 3 / cells), (3, 1 / cells)):  # binomial in each cell
        x, se = got[:, column], math.sqrt(n * p * (1 - p) / len(got))
        assert abs(x.mean() - n * p) < 5 * se and x.var() == pytest.approx(n * p * (1 - p), rel=0.1)
        for k in range(4):
            want = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) if k <= n else 0
            assert abs((x == k).mean() - want) < 5 * math.sqrt(want * (1 - want) / len(got)) + 1e-9


def test_numbers_of_draws_that_were_not_expected():
    for expected, n in ((10_000, 500), (500, 10_000), (1000, 0)):
        one = draws.Cells(np.column_stack([np.arange(600) % 2]), expected)
        got = one.sums(np.random.default_rng(1), np.full(64, n))[:, 0]
        assert abs(got.mean() - n / 2) <= 5 * math.sqrt(n / 4 / 64)


def test_weights():
    rng = np.random.default_rng(5)
    w = np.r_[np.ones(800, int), np.full(700, 4), [9, 11, 5000]]
    x = rng.normal(size=len(w))
    own, n = draws.Weighted(np.column_stack([np.ones(len(w)), x]), w, w.sum()), int(w.sum())
    assert len(own.cells) == 2 and len(own.rest) == 3
    got = np.concatenate([own.sums(np.random.default_rng([2, i]), np.full(32, n)) for i in range(300)])
    p = w / n
    sd = math.sqrt(n * (p @ x**2 - (p @ x) ** 2))
    assert (got[:, 0] == n).all() and abs(got[:, 1].mean() - n * (p @ x)) < 5 * sd / math.sqrt(len(got)) and got[:, 1].std() == pytest.approx(sd, rel=0.05)


def test_a_turn_gets_values_once_packed(spark, monkeypatch):
    monkeypatch.setattr(resample, "CHUNK", 600)
    df = spark.range(6000).select("id", F.when(F.col("id") % 50 != 0, (F.col("id") * 7919 % 2000).cast("double")).alias("v"))
    sums = resample.bootstrap_row_sums(df, "v", "id", 2000)
    plan = sums._jdf.queryExecution().toString()
    assert "MapInArrow" in plan  # before, a row a value for each of 96 turns
    rows = sums.collect()
    assert sorted(r.replicate for r in rows) == list(range(1, 2001)) and sorted(map(tuple, df.repartition(5).transform(lambda d: resample.bootstrap_row_sums(d, "v", "id", 2000)).collect())) == sorted(map(tuple, rows))
    v = np.array([r.v for r in df.collect() if r.v is not None])
    assert fmean(r.n for r in rows) == pytest.approx(len(v), abs=5 * math.sqrt(6000 * 0.02 * 0.98 / 2000))
    means = [r.s1 / r.n for r in rows]
    assert fmean(means) == pytest.approx(v.mean(), abs=5 * v.std() / math.sqrt(len(v) * 2000)) and pstdev(means) == pytest.approx(v.std() / math.sqrt(len(v)), rel=0.08)


def test_infinite_values_are_drawn(spark):
    df = spark.createDataFrame([(k, float("inf") if k == 0 else float(k)) for k in range(40)], "id long, v double")
    rows = resample.bootstrap_row_sums(df, "v", "id", 2000).collect()
    assert all(r.n == 40 for r in rows) and fmean(r.s1 == math.inf for r in rows) == pytest.approx(1 - (39 / 40) ** 40, abs=0.05)


def test_clusters_are_not_hashed(spark, monkeypatch):
    monkeypatch.setattr(resample, "draw", None)
    monkeypatch.setattr(resample, "drawn_slots", None)  # before, an md5 for each cluster and replicate
    monkeypatch.setattr(resample, "_blocks", None)
    df = spark.range(9000).select("id", (F.col("id") % 900).alias("g"), ((F.col("id") % 900) * 1.0).alias("v"))
    got = {r.unit: r for r in resample.compare_resampling_units(df, "v", "id", "g", 2000).collect()}
    sd = math.sqrt((900**2 - 1) / 12)
    assert (got["row"].units, got["cluster"].units, got["row"].estimate) == (9000, 900, 449.5)
    assert got["row"].se == pytest.approx(sd / math.sqrt(9000), rel=0.08) and got["cluster"].se == pytest.approx(sd / math.sqrt(900), rel=0.08)


def test_both_samples_in_one_pass(spark):
    df = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("g"), (F.col("id") % 41 + F.col("id") % 3).cast("double").alias("v"))
    row = effects.cohens_d_interval(df, "v", "g", "a", "b", "id", replicates=1500).first()
    assert row.low < row.cohens_d < row.high and (row.replicates, row.failed) == (1500, 0) and row.se == pytest.approx(math.sqrt(4 / 600), rel=0.1)
    assert effects.cohens_d_interval(df, "v", "g", "a", "none", "id", replicates=100).first().replicates == 0
