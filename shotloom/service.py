"""What an HTTP layer would call: plain functions over a lake of processed tables, returning rows as dictionaries."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.geometry import shot_angle, shot_distance
from .operators import features, hypothesis, models, queries
from .sources.tables import read_table

logger = logging.getLogger(__name__)

#: The model that answers where none is named, if there is one of that name; else the first there is.
DEFAULT_MODEL = "logistic_baseline"
#: Metrics that a listed model must have.
METRICS = ("roc_auc", "log_loss", "brier")


class NotFoundError(LookupError):
    """No such match or model."""


class UnavailableError(RuntimeError):
    """No model has been trained or configured yet."""


@dataclass(frozen=True)
class Service:
    """Endpoints over one lake; models are looked up under ``models_root``."""

    spark: SparkSession
    root: str
    models_root: str | None = None

    def _table(self, name: str) -> DataFrame:
        return read_table(self.spark, name, self.root)

    def health(self) -> dict:
        return {"status": "ok"}

    def summary(self) -> dict:
        return queries.dataset_summary(self._table("matches"), self._table("players"), self._table("shots")).first().asDict()

    def matches(self, limit: int = 20, offset: int = 0) -> dict:
        rows = [r.asDict() for r in queries.list_matches(self._table("matches"), limit=limit, offset=offset).collect()]
        return {"total": rows[0]["total"] if rows else self._table("matches").count(), "items": [{k: v for k, v in r.items() if k != "total"} for r in rows]}

    def dataset(self) -> DataFrame:
        return features.build_shot_features(self._table("shots"), self._table("matches"))

    def models(self) -> dict:
        """The saved models with their metrics and metadata; those that can't be read, or lack a metric, are left out."""
        items = []
        for name in models.list_artifacts(self.spark, self.models_root) if self.models_root else []:
            try:
                found = models.describe_artifact(self.spark, name, self.models_root)
                if any(not isinstance(found["metrics"][m], int | float) for m in METRICS):
                    raise ValueError(f"{METRICS} are needed")
            except (PySparkException, ValueError, KeyError, TypeError) as e:
                logger.warning("model %s is left out: %s", name, str(e).split("\n")[0])
                continue
            items.append(found)
        return {"items": items}

    def _model(self, name: str | None) -> tuple:
        """The name and pipeline of the named model, or of the default one."""
        if self.models_root is None:
            raise UnavailableError("no models are configured")
        found = models.list_artifacts(self.spark, self.models_root)
        if not found:
            raise UnavailableError("no models have been trained")
        name = name or (DEFAULT_MODEL if DEFAULT_MODEL in found else found[0])
        if name not in found:
            raise NotFoundError(f"model {name}: there are {', '.join(found)}")
        try:
            return name, models.load_model(f"{self.models_root}/{name}/model")
        except (PySparkException, Py4JJavaError, ValueError) as e:
            raise UnavailableError(f"model {name} can't be loaded") from e

    def match_shots(self, match_id: int, model: str | None = None) -> dict:
        """A match's shot map with probabilities of the named or default model; they are null where no model has been trained."""
        match = queries.match_row(self._table("matches"), match_id).first()
        if match is None:
            raise NotFoundError(f"match {match_id}")
        data = self.dataset().where(F.col("match_id") == match_id)
        some = bool(self.models_root and models.list_artifacts(self.spark, self.models_root))
        if model and not some:
            raise UnavailableError("no models have been trained")
        chosen, scores = None, None
        if some:
            chosen, fitted = self._model(model)
            scores = models.predict(fitted, data).select("shot_id", "probability")
        shots = queries.match_shots(data, self._table("shots"), match_id, scores)
        return {"match": match.asDict(), "model": chosen, "shots": [r.asDict() for r in shots.collect()]}

    def predict_shot(self, model: str | None, x: float, y: float, **context) -> float:
        """The probability of a shot by a model (the default one for None); its geometry is derived from the location."""
        if not (0 <= x <= 120 and 0 <= y <= 80):
            raise ValueError("the location lies outside the pitch")
        name, fitted = self._model(model)
        wanted = models.load_metrics(self.spark, name, self.models_root, "metadata.json")["features"]
        missing = sorted({f.split("=")[0] for f in wanted} - {"shot_distance", "shot_angle", *(k for k, v in context.items() if v is not None)})
        if missing:
            raise ValueError(f"the model also needs {', '.join(missing)}")
        row = self.spark.createDataFrame([{"x": float(x), "y": float(y), **context}])
        row = row.withColumn("shot_distance", shot_distance(F.col("x"), F.col("y"))).withColumn("shot_angle", shot_angle(F.col("x"), F.col("y")))
        return models.predict(fitted, row).first()["probability"]

    def statistics(self) -> dict:
        """Conversion by body part, Welch's test of the two busiest open-play teams, and independence of body part and goals."""
        shots, data = queries.in_play(self._table("shots")), self.dataset()
        play = data.where("shot_type = 'Open Play'")
        teams = [r["team"] for r in queries.busiest(play, "team").collect()]
        out = {"by_body_part": [r.asDict() for r in queries.conversion_by(shots, "body_part").collect()]}
        if len(teams) == 2:
            out["distance"] = {"teams": teams} | hypothesis.t_test(hypothesis.two_samples(play, "shot_distance", "team", *teams)).first().asDict()
        enough = queries.conversion_by(shots, "body_part", min_shots=5).select("body_part")
        if enough.count() >= 2:
            out["body_part"] = hypothesis.chi_square(data.join(enough, "body_part", "left_semi"), "body_part", "goal").first().asDict()
        return out
