"""The feature table: one row per in-play shot, and its sanity report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import is_valid_location, shot_angle, shot_distance
from ..schemas import DATASET_COLUMNS

MAX_DISTANCE = 126.49


class DatasetError(ValueError):
    """Shots and matches that don't fit together."""


def orphans(shots: DataFrame, matches: DataFrame) -> DataFrame:
    """Shots whose match is unknown."""
    return shots.join(matches, "match_id", "left_anti")


def build_shot_features(shots: DataFrame, matches: DataFrame, *, include_shootouts: bool = False) -> DataFrame:
    """Exactly DATASET_COLUMNS; geometry only where the location is valid, raw coordinates untouched."""
    context = matches.select("match_id", "competition_id", "season_id", "match_date", "stage", "shot_fidelity_version")
    if not matches.groupBy("match_id").count().where("count > 1").isEmpty():
        raise DatasetError("matches has repeated match_id")
    if not orphans(shots, context).isEmpty():
        raise DatasetError("shots refer to unknown matches")
    df = (shots if include_shootouts else shots.where("NOT is_shootout")).join(context, "match_id")
    valid = is_valid_location(F.col("x"), F.col("y"))
    df = df.withColumns(
        {
            "shot_id": F.col("event_id"),
            "goal": F.col("is_goal"),
            "shot_distance": F.when(valid, shot_distance(F.col("x"), F.col("y"))),
            "shot_angle": F.when(valid, shot_angle(F.col("x"), F.col("y"))),
            "high_fidelity_coordinates": F.col("shot_fidelity_version").isNotNull(),
            "has_valid_location": valid,
        }
    )
    return df.select(*DATASET_COLUMNS)


def sanity_report(df: DataFrame, id_col: str = "shot_id", rounded: int = 6) -> DataFrame:
    """One row: counts, rates, ranges, and the number of rows of each problem, in a single pass but for repeated ids."""
    valid = is_valid_location(F.col("x"), F.col("y"))
    d, a = F.col("shot_distance"), F.degrees("shot_angle")
    r = lambda c: F.round(c, rounded)
    facts = df.agg(
        F.count("*").alias("shots"),
        F.count_if("goal").alias("goals"),
        r(F.avg(F.col("goal").cast("double"))).alias("goal_rate"),
        r(F.min(d)).alias("min_distance"),
        r(F.avg(d)).alias("mean_distance"),
        r(F.max(d)).alias("max_distance"),
        r(F.min(a)).alias("min_angle"),
        r(F.avg(a)).alias("mean_angle"),
        r(F.max(a)).alias("max_angle"),
        F.count_if(~valid).alias("invalid_locations"),
        F.count_if(F.col(id_col).isNull() | F.col("match_id").isNull()).alias("null_keys"),
        F.count_if((d < 0) | (d > MAX_DISTANCE)).alias("bad_distances"),
        F.count_if((a < 0) | (a > 180)).alias("bad_angles"),
        F.count_if(valid & (d.isNull() | a.isNull())).alias("missing_geometry"),
    )
    repeated = df.groupBy(id_col).count().where("count > 1").agg(F.count("*").alias("repeated_ids"))
    return facts.select("*", repeated.scalar().alias("repeated_ids"))


def missing_by_column(df: DataFrame, *columns: str) -> DataFrame:
    """Nulls of each column: one aggregate, then unpivoted."""
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot("n", list(columns), "column", "missing").select("column", "missing", F.round(F.col("missing") / F.col("n"), 6).alias("share"))
