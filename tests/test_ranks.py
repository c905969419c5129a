import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotloom.operators import describe, ranks


@pytest.mark.parametrize("kind", ["even", "heavy tail", "close together", "ties", "one"])
def test_quantiles(spark, kind):
    rng = np.random.default_rng(3)
    make = {
        "even": lambda n: rng.uniform(-50, 50, n),
        "heavy tail": lambda n: np.exp(rng.normal(0, 12, n)) * rng.choice((-1, 1), n),
        "close together": lambda n: 1.7e9 + rng.integers(0, 4000, n) / 4096,
        "ties": lambda n: rng.integers(-2, 3, n).astype(float),
        "one": lambda n: np.full(n, 4.25),
    }[kind]
    values = {"a": make(501), None: make(1000), "c": make(1)}
    rows = spark.createDataFrame([(g, float(x)) for g, v in values.items() for x in v], "g string, v double")
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    counts = rows.groupBy("g", "v").agg(F.count("*").alias("n"))
    found = {r["g"]: r["q"] for r in ranks.quantiles(counts, "v", "n", probabilities, ["g"]).collect()}
    assert found.keys() == values.keys()
    for g, v in values.items():
        assert found[g] == pytest.approx(np.quantile(v, probabilities), rel=1e-12)
    whole = ranks.quantiles(rows.groupBy("v").agg(F.count("*").alias("n")), "v", "n", probabilities).first()["q"]
    assert whole == pytest.approx(np.quantile(np.concatenate(list(values.values())), probabilities), rel=1e-12)


def test_quantiles_of_nothing(spark):
    assert ranks.quantiles(spark.createDataFrame([], "v double, n long"), "v", "n", [0.5]).count() == 0


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_ordinal(spark, groups, monkeypatch):
    monkeypatch.setattr(ranks, "SAMPLED", 40)
    rng = np.random.default_rng(4)
    rows = [(f"g{k % 3}" if k % 5 else None, None if k == 7 else f"k{rng.integers(10**6)}é", float(rng.integers(9)), k) for k in range(700)]
    found = ranks.ordinal(spark.createDataFrame(rows, "g string, a string, b double, id long"), ["b", "a", "id"], groups).collect()
    order = lambda r: (r[2], r[1] is not None, (r[1] or "").encode(), r[3])
    for g in {r[0] for r in rows} if groups else [None]:
        own = sorted((r for r in rows if not groups or r[0] == g), key=order)
        got = {r["id"]: r["ordinal"] for r in found if not groups or r["g"] == g}
        assert got == {r[3]: k for k, r in enumerate(own)}
    assert ranks.ordinal(spark.createDataFrame([], "a string"), ["a"]).count() == 0


def test_no_window_holds_a_whole_group(spark):
    """Windows are over ranges of values or over a row per range, never over a group's rows."""
    rows = spark.range(20_000).select((F.col("id") % 2).alias("g"), F.sqrt("id").alias("v"))
    plan = describe.describe_by_group(rows, "v", "g")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
    out = {r["g"]: r for r in describe.describe_by_group(rows, "v", "g").collect()}
    for g in (0, 1):
        v = np.sqrt(np.arange(g, 20_000, 2))
        assert out[g]["median"] == pytest.approx(np.median(v), abs=1e-6) and out[g]["mad"] == pytest.approx(np.median(np.abs(v - np.median(v))), abs=1e-6)


def test_describe_odd_groups(spark):
    nan, inf = float("nan"), math.inf
    rows = [("a", None), ("a", nan), ("a", inf), (None, 1.0), (None, 3.0), (None, -inf), ("b", 2.0)]
    out = {r["g"]: r for r in describe.describe_by_group(spark.createDataFrame(rows, "g string, v double"), "v", "g").collect()}
    assert (out["a"]["n_total"], out["a"]["n_observed"], out["a"]["n_missing"], out["a"]["n_infinite"], out["a"]["median"], out["a"]["n_modified_z"]) == (3, 0, 2, 1, None, 0)
    assert (out[None]["median"], out[None]["mad"], out[None]["n_infinite"], out["b"]["median"], out["b"]["sd"]) == (2.0, 1.0, 1, 2.0, None)
    assert describe.describe_by_group(spark.createDataFrame([], "v double"), "v").count() <= 1
