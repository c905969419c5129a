"""Raw nested JSON: one array of records per file, the match id in the file's name."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RAW


class SourceError(RuntimeError):
    """Raw or processed data that can't be read."""


def _read(spark: SparkSession, entity: str, path: str) -> DataFrame:
    try:
        firsts = spark.read.text(path, wholetext=True).where(F.substr(F.ltrim(F.regexp_replace("value", "^[\\s\\ufeff]+", "")), F.lit(1), F.lit(1)) != "[")
        bad = firsts.select(F.col("_metadata.file_path").alias("f")).head(1)
    except AnalysisException as e:
        raise SourceError(f"{entity}: nothing at {path}; download or place the raw files first") from e
    if bad:
        raise SourceError(f"{entity}: {bad[0]['f']} isn't a JSON array")
    return spark.read.schema(RAW[entity]).option("multiLine", True).option("mode", "FAILFAST").json(path)


def load_competitions(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, "competitions", f"{root}/competitions.json")


def load_matches(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, "matches", f"{root}/matches/*/*.json")


def _with_match_id(df: DataFrame) -> DataFrame:
    return df.withColumn("match_id", F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)\.json$", 1).cast("long"))


def load_events(spark: SparkSession, root: str) -> DataFrame:
    """All events, with ``match_id`` from the file name; files are tasks, so no match is held whole by one process but its own."""
    return _with_match_id(_read(spark, "events", f"{root}/events/*.json"))


def load_lineups(spark: SparkSession, root: str) -> DataFrame:
    return _with_match_id(_read(spark, "lineups", f"{root}/lineups/*.json"))


def _required(df: DataFrame, *names: str) -> DataFrame:
    """The frame with an error, when it runs, at a row that lacks one of the fields."""
    return df.withColumns({c: F.coalesce(F.col(c), F.raise_error(F.lit(f"required field {c} is missing"))) for c in names})


def competition_seasons(competitions: DataFrame) -> DataFrame:
    """A row per competition and season; both ids are required."""
    return _required(competitions, "competition_id", "season_id").select("competition_id", "season_id", "competition_name", "season_name")


def match_ids(matches: DataFrame) -> DataFrame:
    """The ids of raw match records, which are required."""
    return _required(matches, "match_id").select("match_id")


def player_names(lineups: DataFrame) -> DataFrame:
    """(match_id, player_id, player_name) of both teams' players: the nickname, else the full name, one of which must be there.

    A player who is listed again in a match has the name of the last listing.
    """
    rows = lineups.select("match_id", F.posexplode("lineup").alias("_pos", "p"), "team_id")
    rows = rows.select("match_id", "team_id", "_pos", F.col("p.player_id").alias("player_id"), F.coalesce(F.nullif(F.col("p.player_nickname"), F.lit("")), F.nullif(F.col("p.player_name"), F.lit(""))).alias("player_name"))
    rows = _required(rows, "player_id", "player_name")
    return rows.groupBy("match_id", "player_id").agg(F.max_by("player_name", F.struct("team_id", "_pos")).alias("player_name"))


def missing_matches(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Incremental acquisition: the wanted match ids that no file holds yet."""
    return wanted.select("match_id").distinct().join(present.select("match_id"), "match_id", "left_anti")


def limit_matches(matches: DataFrame, limit: int) -> DataFrame:
    """The first matches by date and id; at least one."""
    if limit < 1:
        raise ValueError("limit_matches must be at least 1")
    return matches.orderBy("match_date", "match_id").limit(limit)
