"""The analytical queries over matches, shots and players."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decimal_round(c: Column, digits: int) -> Column:
    """Rounding of the decimal text, half up, so that engines agree on ties."""
    return F.round(c.cast("decimal(28,10)"), digits).cast("double")


def in_play(shots: DataFrame, include_shootouts: bool = False) -> DataFrame:
    """Shootout shots are left out unless asked for."""
    return shots if include_shootouts else shots.where("NOT is_shootout")


def _top(df: DataFrame, limit: int | None, *order: Column) -> DataFrame:
    df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def match_counts_by_competition(matches: DataFrame) -> DataFrame:
    keys = ["competition_id", "season_id", "competition_name", "season_name"]
    rows = matches.groupBy(*keys).agg(
        F.count("*").alias("matches"),
        F.min("match_date").alias("first_match"),
        F.max("match_date").alias("last_match"),
        F.sum("total_goals").cast("long").alias("goals"),
        decimal_round(F.avg("total_goals"), 2).alias("goals_per_match"),
    )
    return rows.orderBy(F.desc("matches"), "competition_id", "season_id")


def shots_by_player(shots: DataFrame, players: DataFrame, *, min_shots: int = 1, limit: int | None = None, include_shootouts: bool = False) -> DataFrame:
    own = in_play(shots, include_shootouts).groupBy("player_id").agg(F.count("*").alias("shots"), decimal_round(F.avg("statsbomb_xg"), 4).alias("mean_statsbomb_xg")).where(F.col("shots") >= min_shots)
    rows = own.join(players.select("player_id", "display_name", "team"), "player_id")
    return _top(rows.select("player_id", F.col("display_name").alias("player"), "team", "shots", "mean_statsbomb_xg"), limit, F.desc("shots"), F.asc("player"), F.asc("player_id"))


def goals_by_player(shots: DataFrame, players: DataFrame, *, limit: int | None = None, include_shootouts: bool = False) -> DataFrame:
    own = in_play(shots, include_shootouts).groupBy("player_id").agg(F.count_if("is_goal").alias("goals"), F.count("*").alias("shots")).where("goals > 0")
    rows = own.join(players.select("player_id", "display_name", "team"), "player_id")
    rows = rows.select("player_id", F.col("display_name").alias("player"), "team", "goals", "shots")
    return _top(rows, limit, F.desc("goals"), F.asc("shots"), F.asc("player"), F.asc("player_id"))


def appearances(matches: DataFrame) -> DataFrame:
    """A row per team and match it played, home or away."""
    sides = [matches.select("match_id", "competition_id", F.col(f"{s}_team_id").alias("team_id"), F.col(f"{s}_team").alias("team")) for s in ("home", "away")]
    return sides[0].unionByName(sides[1])


def shots_by_team(shots: DataFrame, matches: DataFrame, *, include_shootouts: bool = False) -> DataFrame:
    """The denominator of shots per match is the matches that a team played, with or without a shot."""
    played = appearances(matches).groupBy("team").agg(F.countDistinct("match_id").alias("matches"))
    own = in_play(shots, include_shootouts).groupBy("team").agg(F.count("*").alias("shots"), F.count_if("is_goal").alias("goals"), decimal_round(F.sum("statsbomb_xg"), 2).alias("statsbomb_xg"))
    rows = own.join(played, "team").select("team", "matches", "shots", "goals", "statsbomb_xg", decimal_round(F.try_divide("shots", "matches"), 2).alias("shots_per_match"))
    return rows.orderBy(F.desc("shots"), "team")


def player_conversion_rates(shots: DataFrame, players: DataFrame, *, min_shots: int = 0, include_shootouts: bool = False) -> DataFrame:
    """All players; without a shot the rate is null, not zero. Shots are counted per player before the join."""
    own = in_play(shots, include_shootouts).groupBy("player_id").agg(F.count("event_id").alias("shots"), F.count_if("is_goal").alias("goals"), decimal_round(F.sum("statsbomb_xg"), 3).alias("statsbomb_xg"))
    rows = players.join(own, "player_id", "left").select("player_id", F.col("display_name").alias("player"), "team", "squad_listings", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("shots", "goals")], "statsbomb_xg")
    rows = rows.where(F.col("shots") >= min_shots).withColumn("conversion_rate", decimal_round(F.try_divide("goals", "shots"), 4))
    return rows.orderBy(F.desc("goals"), F.desc("shots"), "player", "player_id")


def team_conversion_rates(shots: DataFrame, *, include_shootouts: bool = False) -> DataFrame:
    rows = in_play(shots, include_shootouts).groupBy("team").agg(F.count("*").alias("shots"), F.count_if("is_goal").alias("goals"))
    return rows.withColumn("conversion_rate", decimal_round(F.try_divide("goals", "shots"), 4)).orderBy(F.desc_nulls_last("conversion_rate"), F.desc("shots"), "team")


def dataset_summary(matches: DataFrame, players: DataFrame, shots: DataFrame) -> DataFrame:
    """One row; the rate of no shots is 0 at this boundary."""
    own = in_play(shots).agg(F.count("*").alias("shots"), F.count_if("is_goal").alias("goals"))
    one = lambda df, name: df.agg(F.count("*")).scalar().alias(name)
    return own.select(one(matches, "matches"), one(players, "players"), "shots", "goals", F.coalesce(decimal_round(F.try_divide("goals", "shots"), 6), F.lit(0.0)).alias("goal_rate"))


def list_matches(matches: DataFrame, *, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of matches by date and id, with the number of all."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1 to 100 and offset at least 0")
    total = matches.agg(F.count("*")).scalar()
    return matches.orderBy("match_date", "match_id").offset(offset).limit(limit).withColumn("total", total)


def match_row(matches: DataFrame, match_id: int) -> DataFrame:
    return matches.where(F.col("match_id") == match_id)


def match_shots(dataset: DataFrame, shots: DataFrame, match_id: int, scores: DataFrame | None = None) -> DataFrame:
    """A match's shot map: features, outcome, and the model's probability if there is one."""
    own = dataset.where(F.col("match_id") == match_id)
    facts = shots.where(F.col("match_id") == match_id).select(F.col("event_id").alias("shot_id"), "index", "outcome")
    rows = own.join(facts, "shot_id", "left")
    rows = rows.join(scores, "shot_id", "left") if scores is not None else rows.withColumn("probability", F.lit(None).cast("double"))
    return rows.orderBy("index", "shot_id")


def conversion_by(shots: DataFrame, column: str, *, min_shots: int = 0) -> DataFrame:
    """Shots, goals and rate of each category with at least ``min_shots``."""
    rows = in_play(shots).groupBy(column).agg(F.count("*").alias("shots"), F.count_if("is_goal").alias("goals")).where(F.col("shots") >= min_shots)
    return rows.withColumn("conversion", decimal_round(F.try_divide("goals", "shots"), 4)).orderBy(F.desc("shots"), column)


def busiest(df: DataFrame, column: str, k: int = 2) -> DataFrame:
    """The k categories with most rows, ties by name."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def search_matches(matches: DataFrame, text: str) -> DataFrame:
    """Matches whose label holds the text, whatever its case."""
    label = F.lower(F.concat_ws(" ", "home_team", "away_team", "competition_name", "season_name", "stage"))
    return matches.where(F.contains(label, F.lower(F.trim(F.lit(text)))))


def in_both(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows that both have, once each, of columns of the same kinds: repeats go before rows meet, so no task has all of them."""
    side = lambda df, k: df.toDF(*left.columns).select("*", *[F.lit(int(i == k)).alias(f"_in_{i}") for i in (0, 1)])
    met = side(left, 0).union(side(right, 1)).groupBy(*left.columns).agg(F.max("_in_0").alias("_in_0"), F.max("_in_1").alias("_in_1"))
    return met.where("_in_0 = 1 AND _in_1 = 1").drop("_in_0", "_in_1")
