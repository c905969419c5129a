"""Like tables are tested once, and like rows are drawn at once."""

from statistics import fmean, pstdev

import pytest
from pyspark.sql import functions as F

from shotloom.operators import effects, hypothesis, multiplicity, order_bootstrap, resample


def test_like_tables_are_asked_once(spark):
    df = spark.range(60).selectExpr("id", "id % 3 + 1 AS a", "4L AS b", "5L AS c", "id % 2 + 2 AS d")
    asked = []
    hypothesis.once_per_table(df, lambda own: asked.append(own.count()) or own.withColumn("x", F.lit(1)), "x")
    assert asked == [6]  # before, each row was a test of its own
    for found in (hypothesis.fisher_exact(df), effects.conditional_odds_ratio(df)):
        rows = found.collect()
        assert sorted(r.id for r in rows) == list(range(60)) and len({(r.a, r.d, r.odds_ratio) for r in rows}) == 6


def test_a_family_in_ranges(spark):
    p = [((k * 37 + 11) % 50 + 0.5) / 50 for k in range(400)]
    out = multiplicity.adjust(spark.createDataFrame(list(enumerate(p)), "label long, p_value double"))
    order = sorted(range(400), key=lambda k: (p[k], k))
    least, want = 1.0, {}
    for place in range(400, 0, -1):
        least = min(least, p[order[place - 1]] * 400 / place)
        want[order[place - 1]] = least
    assert {r.label: r.benjamini_hochberg for r in out.collect()} == pytest.approx(want)
    assert "row_number" not in out._jdf.queryExecution().toString()  # before, one task ranked all


@pytest.mark.parametrize("shared", [1, 1000])
def test_rows_of_a_value_are_drawn_at_once(spark, monkeypatch, shared):
    monkeypatch.setattr(resample, "CHUNK", 100)
    monkeypatch.setattr(resample, "SHARED", shared)
    df = spark.range(2000).select("id", F.when(F.col("id") % 10 != 0, (F.col("id") % 250).cast("double")).alias("v"))
    sums = resample.bootstrap_row_sums(df, "v", "id", 1500)
    assert "count(1) AS w" in sums._jdf.queryExecution().analyzed().toString()  # before, rows were copied to every turn
    rows, v = sums.collect(), [r.v for r in df.collect() if r.v is not None]
    assert len(rows) == 1500 and fmean(r.n for r in rows) == pytest.approx(1800, rel=0.01)
    means = [r.s1 / r.n for r in rows]
    assert fmean(means) == pytest.approx(fmean(v), abs=0.3) and pstdev(means) == pytest.approx(pstdev(v) / 1800**0.5, rel=0.1)
    assert fmean(r.s2 / r.n for r in rows) == pytest.approx(fmean(x * x for x in v), rel=0.01)


def test_trimmed_means_of_shared_values(spark, monkeypatch):
    df, found = spark.range(4000).select((F.col("id") % 40).cast("double").alias("v")), []
    for shared in (1, 10**9):  # by values, by rows
        monkeypatch.setattr(order_bootstrap, "SHARED", shared)
        found.append([r.stat for r in order_bootstrap.bootstrap_trimmed_mean(df, "v", 0.1, 800, chunk_rows=512).collect()])
    assert fmean(found[0]) == pytest.approx(fmean(found[1]), abs=0.05) and pstdev(found[0]) == pytest.approx(pstdev(found[1]), rel=0.15)
