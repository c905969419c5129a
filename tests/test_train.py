import shutil

import pytest
from pyspark.sql import functions as F

from shotloom import service
from shotloom.operators import boosting, models


@pytest.fixture(scope="module")
def shots(spark):
    d = spark.range(400).select(
        (F.col("id") % 20).alias("match_id"),
        (2 + F.rand(1) * 38).alias("shot_distance"),
        (F.rand(2) * 1.5).alias("shot_angle"),
        F.when(F.col("id") % 3 == 0, "Head").otherwise("Foot").alias("body_part"),
        F.when(F.col("id") % 11 == 0, "Penalty").otherwise("Open Play").alias("shot_type"),
        F.when(F.col("id") % 5 == 0, "Volley").otherwise("Normal").alias("technique"),
        (F.col("id") % 4 == 0).alias("under_pressure"),
        (F.col("id") % 7 == 0).alias("first_time"),
    )
    return d.withColumn("goal", F.rand(3) < 1 / (1 + F.exp(-(1.4 - 0.2 * F.col("shot_distance") + 1.8 * F.col("shot_angle"))))).cache()


FEW = {
    "logistic_baseline": boosting.ALL_MODELS["logistic_baseline"],
    "logistic_contextual": boosting.ALL_MODELS["logistic_contextual"],
    "boosted_contextual": lambda train, seed: models.fit_boosted(train, **models.CONTEXTUAL, step=0.5, most=4, patience=2, seed=seed),
    "boosted_ordered_contextual": lambda train, seed: boosting.fit_ordered(train, **models.CONTEXTUAL, key="shot_distance", step=0.5, most=2, patience=2, seed=seed),
}


def test_persist_list_and_serve(spark, shots, tmp_path):
    root = str(tmp_path / "models")
    s = service.Service(spark, str(tmp_path), root)
    assert models.list_artifacts(spark, root) == [] and s.models() == {"items": []}
    with pytest.raises(service.UnavailableError):
        s.predict_shot(None, 108, 40)
    assert models.persist_all_models(shots, root, fits=FEW) == list(FEW)
    (tmp_path / "models" / "half" / "metrics.json").mkdir(parents=True)
    (tmp_path / "models" / "half" / "metrics.json" / "part-0").write_text("{}")
    assert models.list_artifacts(spark, root) == sorted(FEW)
    items = {x["name"]: x for x in s.models()["items"]}
    about = items["boosted_contextual"]["metadata"]
    assert (about["n_train_groups"], about["n_test_groups"], about["training_samples"] + about["test_samples"]) == (15, 5, 400)
    assert 1 <= about["n_trees"] <= 4 and "n_trees" not in items["logistic_baseline"]["metadata"]
    assert items["boosted_ordered_contextual"]["metadata"]["trees_grown"] == 2 and items["boosted_ordered_contextual"]["metrics"]["roc_auc"] > 0.6
    assert items["logistic_baseline"]["metrics"]["roc_auc"] > 0.7 and items["logistic_baseline"]["metadata"]["features"] == ["shot_distance", "shot_angle"]
    near, far = (s.predict_shot("logistic_baseline", x, 40) for x in (114, 85))
    assert 0 < far < near < 1
    assert s.predict_shot(None, 114, 40) == near  # the baseline answers where none is named
    with pytest.raises(ValueError, match="body_part"):
        s.predict_shot("logistic_contextual", 108, 40)
    assert 0 < s.predict_shot("logistic_contextual", 108, 40, body_part="Foot", shot_type="Open Play", technique="Normal", under_pressure=False, first_time=True) < 1
    with pytest.raises(service.NotFoundError):
        s.predict_shot("other", 108, 40)
    # without the baseline the first model answers; what can't be read is left out of the list
    few = tmp_path / "few"
    shutil.copytree(tmp_path / "models" / "logistic_contextual", few / "contextual")
    shutil.copytree(tmp_path / "models" / "logistic_contextual", few / "broken")
    for part in (few / "broken" / "metrics.json").iterdir():
        part.write_text("{ not json") if part.name.startswith("part") else part.unlink()
    for crc in (few / "broken" / "metrics.json").glob(".*crc"):
        crc.unlink()
    other = service.Service(spark, str(tmp_path), str(few))
    assert [x["name"] for x in other.models()["items"]] == ["contextual"]
    shutil.rmtree(few / "broken")
    assert 0 < other.predict_shot(None, 108, 40, body_part="Foot", shot_type="Open Play", technique="Normal", under_pressure=False, first_time=True) < 1


def test_repeated_splits(shots, tmp_path):
    fits = {"near": models.fit_logistic, "angle": lambda d: models.fit_logistic(d, numeric=("shot_angle",))}
    rows = models.repeated_splits(shots, fits, str(tmp_path), seeds=(1, 2)).collect()
    assert [(r.seed, r.model) for r in rows] == [(1, "near"), (1, "angle"), (2, "near"), (2, "angle")]
    assert all(r.n == 100 and 0.5 < r.roc_auc < 1 for r in rows if r.model == "near") and rows[0].log_loss != rows[2].log_loss


def test_passthrough(shots):
    assert models.passthrough(shots, **models.CONTEXTUAL).columns == ["shot_distance", "shot_angle", "body_part", "shot_type", "technique", "under_pressure", "first_time"]
    for bad in ({"numeric": ("goal",)}, {"numeric": ("shot_angle", "shot_angle")}, {"numeric": ()}):
        with pytest.raises(ValueError):
            models.passthrough(shots, **bad)
