"""Raw nested records to the four processed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import PRIMARY_KEY, SHOT_FLAGS
from ..sources.tables import apply_schema


def require(name: str) -> Column:
    """A field that must be there: a null fails the job, naming the field."""
    return F.coalesce(F.col(name), F.raise_error(F.lit(f"required field {name} is missing")))


def flag(name: str) -> Column:
    """An absent boolean is false."""
    return F.coalesce(F.col(name), F.lit(False))


def deduplicate(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order, which should be total."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_n", first).where("_n = 1").drop("_n")


def in_file_order(raw: DataFrame, key: str) -> DataFrame:
    """The first raw record of each key: by file, then by its place in the file's array.

    A file is read whole by one task, in order, so rows are numbered as they come.
    """
    placed = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_place"))
    first = F.row_number().over(Window.partitionBy(key).orderBy("_file", "_place"))
    return placed.withColumn("_n", first).where("_n = 1").drop("_n", "_file", "_place")


def normalize_matches(raw: DataFrame) -> DataFrame:
    return apply_schema(
        raw.select(
            require("match_id").alias("match_id"),
            require("competition.competition_id").alias("competition_id"),
            require("season.season_id").alias("season_id"),
            F.col("competition.competition_name"),
            F.col("season.season_name"),
            "kick_off",
            F.col("competition_stage.id").alias("stage_id"),
            F.col("competition_stage.name").alias("stage"),
            "match_week",
            F.col("home_team.home_team_id"),
            F.col("home_team.home_team_name").alias("home_team"),
            F.col("away_team.away_team_id"),
            F.col("away_team.away_team_name").alias("away_team"),
            require("home_score").alias("home_score"),
            require("away_score").alias("away_score"),
            (F.col("home_score") + F.col("away_score")).alias("total_goals"),
            F.col("referee.name").alias("referee"),
            F.col("stadium.name").alias("stadium"),
            F.col("metadata.shot_fidelity_version"),
            F.col("metadata.xy_fidelity_version"),
            F.to_date("match_date").alias("match_date"),
        ),
        "matches",
    )


def _common() -> list[Column | str]:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return [require("id").alias("event_id"), "match_id", require("index").alias("index"), require("period").alias("period"), "timestamp", zero("minute"), zero("second")]


def normalize_events(raw: DataFrame) -> DataFrame:
    """One row per event, common attributes only; an event without a type is kept."""
    refs = [F.col(f"{c}.name").alias(c) for c in ("possession_team", "play_pattern", "position")]
    return apply_schema(
        raw.select(
            *_common(),
            F.col("type.id").alias("type_id"),
            F.col("type.name").alias("type"),
            "possession",
            *refs,
            *[F.col(f"{c}.id").alias(f"{c}_id") for c in ("team", "player")],
            *[F.col(f"{c}.name").alias(c) for c in ("team", "player")],
            F.get("location", F.lit(0)).alias("x"),
            F.get("location", F.lit(1)).alias("y"),
            "duration",
            *[flag(c).alias(c) for c in ("under_pressure", "out", "off_camera")],
        ),
        "events",
    )


def events_of_type(raw: DataFrame, name: str) -> DataFrame:
    return raw.where(F.col("type.name") == name)


def normalize_shots(raw: DataFrame) -> DataFrame:
    """One row per shot with its payload flattened."""
    s = events_of_type(raw, "Shot")
    end = [F.get("shot.end_location", F.lit(k)).alias(f"end_{a}") for k, a in enumerate("xyz")]
    return apply_schema(
        s.select(
            *_common(),
            *[require(f"{c}.id").alias(f"{c}_id") for c in ("team", "player")],
            *[F.col(f"{c}.name").alias(c) for c in ("team", "player", "position", "play_pattern")],
            F.get("location", F.lit(0)).alias("x"),
            F.get("location", F.lit(1)).alias("y"),
            *end,
            F.col("shot.outcome.id").alias("outcome_id"),
            F.col("shot.outcome.name").alias("outcome"),
            F.col("shot.type.name").alias("shot_type"),
            F.col("shot.body_part.name").alias("body_part"),
            F.col("shot.technique.name").alias("technique"),
            F.col("shot.statsbomb_xg"),
            F.col("shot.key_pass_id"),
            F.col("shot.outcome.name").eqNullSafe("Goal").alias("is_goal"),
            (F.col("period") == 5).alias("is_shootout"),
            F.col("shot.freeze_frame").isNotNull().alias("has_freeze_frame"),
            flag("under_pressure").alias("under_pressure"),
            *[flag(f"shot.{c}").alias(c) for c in SHOT_FLAGS],
        ),
        "shots",
    )


def squad_listings(raw: DataFrame) -> DataFrame:
    """A row per player, team and match, with its place in the file."""
    teams = raw.select("match_id", "team_id", "team_name", F.posexplode("lineup").alias("pos", "p"))
    return teams.select(
        "match_id",
        "team_id",
        F.col("team_name").alias("team"),
        "pos",
        require("p.player_id").alias("player_id"),
        require("p.player_name").alias("player_name"),
        F.col("p.player_nickname"),
        F.coalesce(F.nullif(F.col("p.player_nickname"), F.lit("")), F.col("p.player_name")).alias("display_name"),
        F.col("p.country.name").alias("country"),
        (F.coalesce(F.size("p.positions"), F.lit(0)) > 0).alias("has_position"),
    )


def build_players(listings: DataFrame) -> DataFrame:
    """A row per player: the first value known of each attribute, by match, team and place."""
    firsts = [F.expr(f"min_by({c}, struct(match_id, team_id, pos)) FILTER (WHERE {c} IS NOT NULL)").alias(c) for c in ("player_name", "player_nickname", "display_name", "country", "team_id", "team")]
    return apply_schema(listings.groupBy("player_id").agg(*firsts, F.countDistinct("match_id").alias("squad_listings"), F.count_if("has_position").alias("matches_with_position")), "players")


def build_tables(matches: DataFrame, events: DataFrame, lineups: DataFrame) -> dict[str, DataFrame]:
    """The four processed tables from raw records as they are read; repeated ids keep the first record of the files."""
    once = in_file_order(events, "id")
    return {
        "matches": normalize_matches(in_file_order(matches, PRIMARY_KEY["matches"])),
        "events": normalize_events(once),
        "shots": normalize_shots(once),
        "players": build_players(squad_listings(lineups)),
    }
