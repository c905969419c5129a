"""Goal-probability models on Spark ML, and their artifacts."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import LEAKY
from .evaluate import assert_no_leakage, group_split, metrics, one_hot_levels

BASELINE = ("shot_distance", "shot_angle")
CONTEXTUAL = {"numeric": BASELINE, "categorical": ("body_part", "shot_type", "technique"), "boolean": ("under_pressure", "first_time")}


def reject_leaky_features(columns) -> None:
    bad = sorted(set(columns) & LEAKY)
    if bad:
        raise ValueError(f"leaky features: {bad}")


def _encoder(train: DataFrame, numeric, categorical, boolean, scale: bool) -> tuple[list, list[str]]:
    """SQL stages that encode as fitted on ``train``: standardised numbers, indicator columns but for the first level, flags."""
    columns = [*numeric, *categorical, *boolean]
    reject_leaky_features(columns)
    if len(set(columns)) != len(columns) or not columns:
        raise ValueError("feature columns must be given once each, and at least one")
    stats = train.agg(*[F.avg(c).alias(f"m_{k}") for k, c in enumerate(numeric)], *[F.stddev_pop(c).alias(f"s_{k}") for k, c in enumerate(numeric)]).first() if numeric else None
    out = [f"(`{c}` - {float(stats[f'm_{k}'])!r}D) / {float(stats[f's_{k}'] or 1)!r}D AS f{k}" if scale else f"CAST(`{c}` AS DOUBLE) AS f{k}" for k, c in enumerate(numeric)]
    names = [*numeric]
    for c in categorical:
        levels = [r["level"] for r in one_hot_levels(train, c).orderBy("code").collect()]
        known = ", ".join("'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'" for x in levels)
        for x in levels[1:]:
            text = str(x).replace("\\", "\\\\").replace("'", "\\'")
            test = f"`{c}` = '{text}'" + (f" OR `{c}` NOT IN ({known}) OR `{c}` IS NULL" if x == "infrequent" else "")
            out.append(f"CAST(coalesce({test}, false) AS DOUBLE) AS f{len(names)}")
            names.append(f"{c}={x}")
    for c in boolean:
        out.append(f"CAST(`{c}` AS DOUBLE) AS f{len(names)}")
        names.append(c)
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(out)} FROM __THIS__"), VectorAssembler(inputCols=[f"f{k}" for k in range(len(names))], outputCol="features")]
    return stages, names


@dataclass(frozen=True)
class Fitted:
    model: PipelineModel
    names: list[str]
    trees: int | None = None
    #: Of histogram boosting: gain by feature, and what the stopping rule found.
    gains: dict[str, float] | None = None
    notes: dict | None = None


def _labelled(df: DataFrame) -> DataFrame:
    out = df.withColumn("label", F.col("goal").cast("double"))
    if out.select("label").distinct().count() < 2:
        raise ValueError("the target has one class only")
    return out


def fit_logistic(train: DataFrame, numeric=BASELINE, categorical=(), boolean=(), c: float = 1.0) -> Fitted:
    """L2 logistic regression of summed loss weight ``c``, on standardised numbers."""
    rows = _labelled(train.dropna(subset=list(numeric)))
    stages, names = _encoder(rows, numeric, categorical, boolean, True)
    last = LogisticRegression(regParam=1 / (c * rows.count()), elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-10)
    return Fitted(Pipeline(stages=[*stages, last]).fit(rows), names)


def chosen_trees(losses, most: int, patience: int) -> int:
    """Trees up to the least of ``losses(n)``, with n doubled until patience runs out; longer trials begin with the same trees."""
    n = min(most, 2 * patience)
    while True:
        best, found = 0, losses(n)
        for k, x in enumerate(found):
            if x < found[best]:
                best = k
            elif k - best >= patience:
                return best + 1
        if n >= most:
            return best + 1
        n = min(most, 2 * n)


def fit_boosted(train: DataFrame, group: str = "match_id", numeric=BASELINE, categorical=(), boolean=(), *, step: float = 0.05, depth: int = 3, least: int = 5, subsample: float = 0.8, colsample: float = 0.8, most: int = 600, patience: int = 40, seed: int = 42) -> Fitted:
    """Gradient-boosted trees; the number of trees is chosen on a fifth of the groups, with patience, then refitted."""
    rows = _labelled(train.dropna(subset=list(numeric)))
    split = rows.join(group_split(rows, group, 0.2, seed), group)
    inner, held = split.where("NOT is_test"), split.where("is_test")
    make = lambda n: GBTClassifier(stepSize=step, maxDepth=depth, minInstancesPerNode=least, subsamplingRate=subsample, featureSubsetStrategy=str(colsample), maxIter=n, seed=seed)
    stages, _ = _encoder(inner, numeric, categorical, boolean, False)

    def losses(n: int) -> list[float]:
        trial = Pipeline(stages=[*stages, make(n)]).fit(inner)
        return trial.stages[-1].evaluateEachIteration(trial.stages[1].transform(trial.stages[0].transform(held)))

    trees = chosen_trees(losses, most, patience)
    stages, names = _encoder(rows, numeric, categorical, boolean, False)
    return Fitted(Pipeline(stages=[*stages, make(trees)]).fit(rows), names, trees)


def predict(fitted: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``probability`` of a goal."""
    out = fitted.transform(df)
    return out.select(*df.columns, vector_to_array(F.col("probability"))[1].alias("probability"))


def coefficients(fitted: Fitted, spark: SparkSession) -> DataFrame:
    """Intercept first, then by size, with odds ratios."""
    m = fitted.model.stages[-1]
    rows = [("intercept", float(m.intercept), 0)] + [(n, float(c), 1) for n, c in zip(fitted.names, m.coefficients, strict=True)]
    return spark.createDataFrame(rows, "feature string, coefficient double, part int").withColumn("odds_ratio", F.exp("coefficient")).orderBy("part", F.desc(F.abs("coefficient"))).drop("part")


def feature_importance(fitted: Fitted, spark: SparkSession) -> DataFrame:
    m = fitted.model.stages[-1].featureImportances
    rows = [(n, float(m[k])) for k, n in enumerate(fitted.names)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def passthrough(df: DataFrame, numeric=BASELINE, categorical=(), boolean=()) -> DataFrame:
    """The feature columns as they are, for learners that encode for themselves; leaky or repeated names are an error."""
    columns = [*numeric, *categorical, *boolean]
    reject_leaky_features(columns)
    if len(set(columns)) != len(columns) or not columns:
        raise ValueError("feature columns must be given once each, and at least one")
    return df.select(*columns)


def repeated_splits(df: DataFrame, fits: dict, root: str, group: str = "match_id", seeds=range(8), test_size: float = 0.25) -> DataFrame:
    """A row per seed and model: the metrics on the test groups of a split by that seed, of a model fitted on the others.

    ``fits`` names functions of a training table that return a ``Fitted``. Models of one seed share its split; each is kept
    as the artifact ``name_seed`` under ``root``, and its metrics are those of the saved model.
    """
    out, columns = [], ("n", "roc_auc", "average_precision", "log_loss", "brier")
    for seed in seeds:
        split = df.join(group_split(df, group, test_size, seed), group)
        train, test = split.where("NOT is_test").drop("is_test"), split.where("is_test").drop("is_test")
        for name, fit in fits.items():
            save_artifact(fit(train), f"{name}_{seed}", root, test, {"random_state": int(seed), "test_size": test_size})
            found = load_metrics(df.sparkSession, f"{name}_{seed}", root)
            out.append((int(seed), name, *(found[c] for c in columns)))
    return df.sparkSession.createDataFrame(out, "seed long, model string, n long, roc_auc double, average_precision double, log_loss double, brier double")


def persist_all_models(df: DataFrame, root: str, group: str = "match_id", test_size: float = 0.25, seed: int = 42, fits: dict | None = None) -> list[str]:
    """Fits every model (``boosting.ALL_MODELS``) on one split by groups and saves each with its metrics on the test groups; returns their names."""
    split = df.join(group_split(df, group, test_size, seed), group)
    train, test = split.where("NOT is_test").drop("is_test"), split.where("is_test").drop("is_test")
    assert_no_leakage(train, test, group)
    sizes = {
        "training_samples": train.count(),
        "test_samples": test.count(),
        "n_train_groups": train.select(group).distinct().count(),
        "n_test_groups": test.select(group).distinct().count(),
        "validation_strategy": "group_by_match",
        "group_column": group,
        "test_size": test_size,
        "random_state": seed,
    }
    if fits is None:
        from .boosting import ALL_MODELS as fits
    for name, fit in fits.items():
        fitted = fit(train, seed)
        save_artifact(fitted, name, root, test, sizes | ({"n_trees": fitted.trees} if fitted.trees else {}) | (fitted.notes or {}))
    return list(fits)


def save_artifact(fitted: Fitted, name: str, root: str, test: DataFrame, metadata: dict) -> None:
    """model, metrics.json and metadata.json under root/name, written by Spark so that any store will do."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
        raise ValueError("an artifact's name is a bare path segment")
    spark = test.sparkSession
    fitted.model.write().overwrite().save(f"{root}/{name}/model")
    # the metrics of what was saved, not of the fitted object with its training summary
    found = metrics(predict(PipelineModel.load(f"{root}/{name}/model"), test), "goal", "probability").first().asDict()
    for file, content in (("metrics.json", found), ("metadata.json", metadata | {"features": fitted.names})):
        spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/{name}/{file}")


def load_metrics(spark: SparkSession, name: str, root: str, file: str = "metrics.json") -> dict:
    return json.loads(spark.read.text(f"{root}/{name}/{file}").first()[0])


def list_artifacts(spark: SparkSession, root: str) -> list[str]:
    """Names of the complete artifacts under a folder: those with a model, metrics and metadata. None for no folder."""
    found = []
    for part in ("model/metadata", "metrics.json", "metadata.json"):
        try:
            files = spark.read.text(f"{root}/*/{part}").select(F.col("_metadata.file_path").alias("f"))
            names = {r["name"] for r in files.select(F.element_at(F.split("f", "/"), -2 - len(part.split("/"))).alias("name")).distinct().collect()}
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            names = set()
        found.append(names)
    return sorted(set.intersection(*found))


def describe_artifact(spark: SparkSession, name: str, root: str) -> dict:
    """An artifact's name, metrics and metadata; the model isn't loaded."""
    return {"name": name, "metrics": load_metrics(spark, name, root), "metadata": load_metrics(spark, name, root, "metadata.json")}


@lru_cache(maxsize=8)
def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
