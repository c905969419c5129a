import math

import pytest
from pyspark.sql import functions as F

from shotloom.functions import special
from shotloom.functions.geometry import is_valid_location, shot_angle, shot_distance
from shotloom.operators import effects, hypothesis, models, multiplicity, resample


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: special.lgamma(10.0), math.lgamma(10)),
        (lambda: special.lgamma(0.5), math.lgamma(0.5)),
        (lambda: 2 * special.t_sf(2.0, 10), 0.0733880347707403),
        (lambda: special.chi2_sf(3.841458820694124, 1), 0.05),
        (lambda: special.chi2_sf(0.5, 4), math.exp(-0.25) * 1.25),
        (lambda: special.normal_sf(1.959963984540054), 0.025),
        (lambda: special.f_sf(4.9646027437307145, 1, 10), 0.05),
        (lambda: special.t_ppf(0.975, 10), 2.2281388519649385),
    ],
)
def test_distributions(spark, column, want):
    assert value(spark, column()) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize(("x", "y", "distance", "angle"), [(108, 40, 12, None), (60, 40, 60, None), (120, 40, 0, math.pi), (120, 36, 4, 0.0), (120, 30, 10, 0.0)])
def test_geometry(spark, x, y, distance, angle):
    a, b = F.lit(float(x)), F.lit(float(y))
    assert value(spark, shot_distance(a, b)) == pytest.approx(distance)
    if angle is not None:
        assert value(spark, shot_angle(a, b)) == pytest.approx(angle)
    assert value(spark, is_valid_location(a, b))
    assert not value(spark, is_valid_location(F.lit(None).cast("double"), b))


def test_fisher_and_effects(spark):
    t = spark.createDataFrame([(3, 1, 1, 3)], "a long, b long, c long, d long")
    row = hypothesis.fisher_exact(t).first()
    assert row.p_value == pytest.approx(0.4857142857142857) and row.odds_ratio == 9
    assert effects.risk_difference(t).first().risk_difference == 0.5


def test_two_samples(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3)] + [("b", float(x)) for x in (10, 11, 12)] + [("b", None)], "g string, v double")
    t = hypothesis.t_test(hypothesis.two_samples(df, "v", "g", "a", "b"), equal_variance=True).first()
    assert t.df == 4 and t.t == pytest.approx(-9 / math.sqrt(2 / 3)) and "missing or infinite values were dropped" in t.warnings
    m = hypothesis.mann_whitney(df, "v", "g", "a", "b").first()
    assert (m.u, m.superiority) == (0, 0)
    assert effects.cohens_d(hypothesis.two_samples(df, "v", "g", "a", "b")).first().cohens_d == pytest.approx(-9)


def test_exact_permutation():
    assert resample.exact_permutation([1, 2, 3], [10, 11, 12]) == pytest.approx(0.1)
    assert resample.exact_permutation([1, 2, 3], [10, 11, 12], "less") == pytest.approx(0.05)


def test_multiplicity(spark):
    p = [0.001, 0.01, 0.02, 0.9]
    df = spark.createDataFrame([(str(k), x) for k, x in enumerate(p)], "label string, p_value double")
    rows = multiplicity.adjust(df).orderBy("label").collect()
    assert [round(r.bonferroni, 6) for r in rows] == [0.004, 0.04, 0.08, 1.0]
    assert [round(r.benjamini_hochberg, 6) for r in rows] == [0.004, 0.02, round(0.02 * 4 / 3, 6), 0.9]
    with pytest.raises(Exception, match="p-values"):
        multiplicity.adjust(df.withColumn("p_value", F.lit(2.0))).collect()


def test_leaky_features():
    with pytest.raises(ValueError, match="leaky"):
        models.reject_leaky_features(["x", "statsbomb_xg"])


def test_logistic_and_artifacts(spark, tmp_path):
    d = spark.range(600).select((F.col("id") % 20).alias("match_id"), (2 + F.rand(1) * 38).alias("shot_distance"), F.rand(2).alias("shot_angle"), F.when(F.col("id") % 3 == 0, "Head").otherwise("Foot").alias("body_part"))
    d = d.withColumn("goal", F.rand(3) < 1 / (1 + F.exp(-(1.5 - 0.22 * F.col("shot_distance"))))).cache()
    fit = models.fit_logistic(d, categorical=("body_part",))
    c = {r.feature: r.coefficient for r in models.coefficients(fit, spark).collect()}
    assert c["shot_distance"] < 0 and "body_part=Head" in c
    models.save_artifact(fit, "logistic_baseline", str(tmp_path), d, {"seed": 1})
    assert models.load_metrics(spark, "logistic_baseline", str(tmp_path))["roc_auc"] > 0.7
    with pytest.raises(ValueError):
        models.save_artifact(fit, "../x", str(tmp_path), d, {})


def test_compare_resampling_units(spark):
    # rows of a cluster are equal: ten independent values, not 200
    df = spark.range(200).select("id", (F.col("id") % 10).alias("g"), ((F.col("id") % 10) * 1.0).alias("v"))
    got = {r.unit: r for r in resample.compare_resampling_units(df, "v", "id", "g", 2000).collect()}
    assert set(got) == {"row", "cluster"} and got["row"].units == 200 and got["cluster"].units == 10
    sd = math.sqrt(8.25)
    assert got["row"].se == pytest.approx(sd / math.sqrt(200), rel=0.08) and got["cluster"].se == pytest.approx(sd / math.sqrt(10), rel=0.08)
    assert got["row"].se_ratio == pytest.approx(got["cluster"].se / got["row"].se)


def test_row_draws_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(resample, "CHUNK", 30)
    df = spark.range(200).select("id", F.when(F.col("id") < 190, F.col("id") * 1.0).alias("v"))
    a, b = (sorted(map(tuple, resample.bootstrap_row_means(df.repartition(n), "v", "id", 1000).collect())) for n in (2, 5))
    assert a == b and len(a) == 1000
    mean = sum(x for _, x in a) / 1000
    assert mean == pytest.approx(94.5, abs=0.6)
    assert math.sqrt(sum((x - mean) ** 2 for _, x in a) / 999) == pytest.approx(math.sqrt((190**2 - 1) / 12 / 190), rel=0.1)


def test_boosting_ends_by_patience_not_by_its_budget(spark):
    import inspect

    given = {k: v.default for k, v in inspect.signature(models.fit_boosted).parameters.items()}
    assert (given["most"], given["patience"]) == (600, 40)
    for least in (0, 59, 150, 590):
        assert models.chosen_trees(lambda n, m=least: [abs(k - m) for k in range(n)], given["most"], given["patience"]) == least + 1
    d = spark.range(200).select((F.col("id") % 20).alias("match_id"), (2 + F.rand(1) * 38).alias("shot_distance"), F.rand(2).alias("shot_angle"))
    d = d.withColumn("goal", F.rand(3) < 1 / (1 + F.exp(-(1.5 - 0.22 * F.col("shot_distance"))))).cache()
    fit = models.fit_boosted(d, step=0.5, most=4, patience=2)
    assert 1 <= fit.trees <= 4 and fit.model.stages[-1].getFeatureSubsetStrategy() == "0.8"


def test_draws_are_never_broadcast(spark, monkeypatch):
    u = resample.units(spark.range(50).select("id", (F.col("id") * 1.0).alias("v")), "v", "id")
    few = resample.bootstrap_means(u, 300)
    assert "BuildLeft" not in few._jdf.queryExecution().toString() and "BuildRight" in few._jdf.queryExecution().toString()
    monkeypatch.setattr(resample, "FEW_UNITS", 10)
    many = resample.bootstrap_means(u, 300)
    assert "SortMergeJoin" in many._jdf.queryExecution().toString()
    near = lambda df: [round(r.mean, 9) for r in df.orderBy("replicate").collect()]
    assert near(few) == near(many)
