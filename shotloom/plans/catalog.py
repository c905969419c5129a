"""Every operator as a query over the driver's tables, and the same result in independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import is_valid_location, marker_radius, shot_angle, shot_distance
from ..operators import boosting, describe, effects, evaluate, explore, features, hypothesis, multiplicity, normalize, order_bootstrap, proportions, queries, resample
from ..streaming.ingest import windowed_counts
from .standins import load, oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
R = 6


def query(sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a function of a table loader under its own name."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: load(spark, sf_dir, name))
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return register


def rounded(df: DataFrame, digits: int = R) -> DataFrame:
    """Doubles rounded, for comparison across engines whose sums differ in order."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


DR = "round(({})::DECIMAL(28,10), {})::DOUBLE"


# -- analytical queries -----------------------------------------------------------------------------------------------
@query(f"SELECT competition_id, season_id, competition_name, season_name, count(*) AS matches, min(match_date)::VARCHAR AS first_match, max(match_date)::VARCHAR AS last_match, sum(total_goals)::BIGINT AS goals, {DR.format('avg(total_goals)', 2)} AS goals_per_match FROM matches GROUP BY ALL")
def match_counts(t):
    m = queries.match_counts_by_competition(t("matches"))
    return m.withColumns({c: F.col(c).cast("string") for c in ("first_match", "last_match")})


_SHOTS_BY_PLAYER = f"SELECT player_id, display_name AS player, p.team, count(*) AS shots, {DR.format('avg(statsbomb_xg)', 4)} AS mean_statsbomb_xg FROM shots s JOIN players p USING (player_id) WHERE {{}} GROUP BY ALL {{}}"


@query(_SHOTS_BY_PLAYER.format("NOT is_shootout", ""))
def shots_by_player(t):
    return queries.shots_by_player(t("shots"), t("players"))


@query(_SHOTS_BY_PLAYER.format("NOT is_shootout", "HAVING count(*) >= 30"))
def shots_by_player_min(t):
    return queries.shots_by_player(t("shots"), t("players"), min_shots=30)


@query(_SHOTS_BY_PLAYER.format("NOT is_shootout", "ORDER BY shots DESC, player, player_id LIMIT 10"))
def shots_by_player_topk(t):
    return queries.shots_by_player(t("shots"), t("players"), limit=10)


@query(_SHOTS_BY_PLAYER.format("TRUE", ""))
def shots_by_player_incl(t):
    return queries.shots_by_player(t("shots"), t("players"), include_shootouts=True)


_GOALS = f"SELECT player_id, display_name AS player, p.team, count(*) FILTER (WHERE is_goal) AS goals, count(*) AS shots FROM shots s JOIN players p USING (player_id) WHERE {{}} GROUP BY ALL HAVING goals > 0"


@query(_GOALS.format("NOT is_shootout"))
def goals_by_player(t):
    return queries.goals_by_player(t("shots"), t("players"))


@query(_GOALS.format("TRUE"))
def goals_by_player_incl(t):
    return queries.goals_by_player(t("shots"), t("players"), include_shootouts=True)


@query(
    f"WITH app AS (SELECT home_team AS team, match_id FROM matches UNION ALL SELECT away_team, match_id FROM matches), played AS (SELECT team, count(DISTINCT match_id) AS matches FROM app GROUP BY team), "
    f"own AS (SELECT team, count(*) AS shots, count(*) FILTER (WHERE is_goal) AS goals, {DR.format('sum(statsbomb_xg)', 2)} AS statsbomb_xg FROM shots WHERE NOT is_shootout GROUP BY team) "
    f"SELECT team, played.matches, shots, goals, statsbomb_xg, {DR.format('shots / played.matches', 2)} AS shots_per_match FROM own JOIN played USING (team)"
)
def shots_by_team(t):
    return queries.shots_by_team(t("shots"), t("matches"))


@query(f"SELECT p.player_id, display_name AS player, p.team, p.squad_listings, {DR.format('sum(s.statsbomb_xg)', 3)} AS statsbomb_xg, count(s.event_id) AS shots, count(*) FILTER (WHERE s.is_goal) AS goals, {DR.format('count(*) FILTER (WHERE s.is_goal) / nullif(count(s.event_id), 0)', 4)} AS conversion_rate FROM players p LEFT JOIN shots s ON p.player_id = s.player_id AND NOT s.is_shootout GROUP BY ALL")
def player_conversion(t):
    return queries.player_conversion_rates(t("shots"), t("players"))


@query(f"SELECT team, count(*) AS shots, count(*) FILTER (WHERE is_goal) AS goals, {DR.format('count(*) FILTER (WHERE is_goal) / count(*)', 4)} AS conversion_rate FROM shots WHERE NOT is_shootout GROUP BY team")
def team_conversion(t):
    return queries.team_conversion_rates(t("shots"))


@query(f"SELECT (SELECT count(*) FROM matches) AS matches, (SELECT count(*) FROM players) AS players, count(*) AS shots, count(*) FILTER (WHERE is_goal) AS goals, {DR.format('count(*) FILTER (WHERE is_goal) / count(*)', 6)} AS goal_rate FROM shots WHERE NOT is_shootout")
def dataset_summary(t):
    return queries.dataset_summary(t("matches"), t("players"), t("shots"))


@query("SELECT match_id, match_date::VARCHAR AS match_date, home_team, away_team, (SELECT count(*) FROM matches) AS total FROM matches m ORDER BY m.match_date, match_id LIMIT 20 OFFSET 40")
def list_matches_page(t):
    return queries.list_matches(t("matches").select("match_id", "match_date", "home_team", "away_team"), limit=20, offset=40).withColumn("match_date", F.col("match_date").cast("string"))


@query("SELECT match_id, competition_id, home_team, away_team FROM matches WHERE match_id = 7")
def match_row(t):
    return queries.match_row(t("matches"), 7).select("match_id", "competition_id", "home_team", "away_team")


@query("SELECT event_id AS shot_id, idx AS index, outcome, x, y FROM shots WHERE match_id = 7 AND NOT is_shootout")
def match_shots(t):
    data = queries.in_play(t("shots")).select(F.col("event_id").alias("shot_id"), "match_id", "x", "y", "idx", "outcome").where("match_id = 7")
    return data.select("shot_id", F.col("idx").alias("index"), "outcome", "x", "y").orderBy("index", "shot_id")


@query(f"SELECT body_part, count(*) AS shots, count(*) FILTER (WHERE is_goal) AS goals, {DR.format('count(*) FILTER (WHERE is_goal) / count(*)', 4)} AS conversion FROM shots WHERE NOT is_shootout GROUP BY body_part HAVING count(*) >= 5")
def conversion_by_category(t):
    return queries.conversion_by(t("shots"), "body_part", min_shots=5)


@query("SELECT team, count(*) AS n FROM shots WHERE shot_type = 'Open Play' GROUP BY team ORDER BY n DESC, team LIMIT 2")
def busiest_groups(t):
    return queries.busiest(t("shots").where("shot_type = 'Open Play'"), "team")


@query("SELECT match_id FROM matches WHERE contains(lower(concat_ws(' ', home_team, away_team, competition_name, season_name, stage)), 'team 3 ')")
def search_matches(t):
    m = queries.search_matches(t("matches"), " TEAM 3").select("match_id", F.lower(F.concat_ws(" ", "home_team", "away_team", "competition_name", "season_name", "stage")).alias("k"))
    return m.where(F.contains("k", F.lit("team 3 "))).select("match_id")


# -- flattening, filters, dedup ---------------------------------------------------------------------------------------
@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) WHERE n = 1")
def dedup_first(t):
    rows = t("lineitem").withColumn("k", F.struct("l_orderkey", "l_linenumber"))
    return normalize.deduplicate(rows, "k", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("SELECT event_id, event_type, (props->>'$.k')::BIGINT AS k, coalesce((props->>'$.flag')::BOOLEAN, false) AS flag FROM events")
def json_flatten(t):
    p = F.from_json("props", "k long, flag boolean")
    return t("events").withColumn("p", p).select("event_id", "event_type", F.col("p.k").alias("k"), F.coalesce("p.flag", F.lit(False)).alias("flag"))


@query("SELECT event_id, value FROM events WHERE event_type = 'click'")
def events_of_type(t):
    return t("events").where("event_type = 'click'").select("event_id", "value")


@query("SELECT conv_id AS player_id, min_by(role, turn) AS first_role, count(*) AS squad_listings, count(DISTINCT role) AS roles, count(*) FILTER (WHERE length(text) > 0) AS with_text FROM conversations GROUP BY conv_id")
def players_agg(t):
    return t("conversations").groupBy(F.col("conv_id").alias("player_id")).agg(F.min_by("role", "turn").alias("first_role"), F.count("*").alias("squad_listings"), F.countDistinct("role").alias("roles"), F.count_if(F.length("text") > 0).alias("with_text"))


@query("SELECT match_id FROM matches WHERE match_id NOT IN (SELECT match_id FROM shots)")
def orphans_anti(t):
    return features.orphans(t("matches"), t("shots")).select("match_id")


@query("SELECT team FROM shots WHERE is_goal INTERSECT SELECT home_team FROM matches WHERE total_goals = 0")
def overlap_intersect(t):
    return queries.in_both(t("shots").where("is_goal").select("team"), t("matches").where("total_goals = 0").select(F.col("home_team").alias("team")))


@query("SELECT match_id, competition_id, home_team_id AS team_id, home_team AS team FROM matches UNION ALL SELECT match_id, competition_id, away_team_id, away_team FROM matches")
def appearances_union(t):
    return queries.appearances(t("matches"))


@query("SELECT match_id, stage, CASE WHEN stage = 'MACHINERY' THEN 'group' ELSE 'knockout' END AS phase FROM matches")
def phase(t):
    return t("matches").select("match_id", "stage", F.when(F.col("stage").eqNullSafe("MACHINERY"), "group").otherwise("knockout").alias("phase"))


# -- geometry and features --------------------------------------------------------------------------------------------
_GEO = "sqrt((120 - x) * (120 - x) + (40 - y) * (40 - y))"
_ANGLE = "atan2(8.0 * abs(120 - x), (120 - x) * (120 - x) + (y - 36) * (y - 44))"
_VALID = "(x BETWEEN 0 AND 120 AND y BETWEEN 0 AND 80)"


@query(f"SELECT event_id, match_id, price, round({_GEO}, 6) AS distance, round({_ANGLE}, 6) AS angle, round(coalesce(1.05 + 4.2 * least(greatest(statsbomb_xg, 0.0), 1.0), 1.35), 6) AS radius, x % 1 <> 0 OR y % 1 <> 0 AS decimal FROM shots")
def geometry(t):
    x, y = F.col("x"), F.col("y")
    return rounded(t("shots").select("event_id", "match_id", "price", shot_distance(x, y).alias("distance"), shot_angle(x, y).alias("angle"), marker_radius(F.col("statsbomb_xg")).alias("radius"), ((x % 1 != 0) | (y % 1 != 0)).alias("decimal")))


@query(f"SELECT {_VALID} AS valid, count(*) AS n FROM shots GROUP BY 1")
def valid_location(t):
    return t("shots").groupBy(is_valid_location(F.col("x"), F.col("y")).alias("valid")).agg(F.count("*").alias("n"))


def _dataset(t) -> DataFrame:
    shots = t("shots").withColumns({c: F.lit(None).cast("string") for c in ("play_pattern", "position")} | {c: F.lit(False) for c in ("open_goal", "deflected", "aerial_won", "follows_dribble", "redirect")} | {"second": F.lit(0)}).drop("stage", "season_id").withColumn("has_freeze_frame", F.col("under_pressure"))
    return features.build_shot_features(shots, t("matches"))


@query(f"SELECT event_id AS shot_id, s.match_id, competition_id, m.season_id, s.x, s.y, CASE WHEN {_VALID} THEN round({_GEO}, 6) END AS shot_distance, CASE WHEN {_VALID} THEN round({_ANGLE}, 6) END AS shot_angle, shot_fidelity_version IS NOT NULL AS high_fidelity_coordinates, is_goal AS goal FROM shots s JOIN matches m ON s.match_id = m.match_id WHERE NOT is_shootout")
def shot_features(t):
    return _dataset(t).select("shot_id", "match_id", "competition_id", "season_id", "x", "y", F.round("shot_distance", R).alias("shot_distance"), F.round("shot_angle", R).alias("shot_angle"), "high_fidelity_coordinates", "goal")


_FLAGS = ("open_goal", "deflected", "aerial_won", "follows_dribble", "redirect")


@query(
    f"SELECT event_id AS shot_id, s.match_id, m.competition_id, m.season_id, s.team_id, s.player_id, s.player, s.team, m.match_date::VARCHAR AS match_date, m.stage, 0 AS second, "
    f"CASE WHEN {_VALID} THEN round({_GEO}, 6) END AS shot_distance, CASE WHEN {_VALID} THEN round({_ANGLE}, 6) END AS shot_angle, s.x, s.y, minute, period, shot_type, body_part, technique, NULL::VARCHAR AS play_pattern, NULL::VARCHAR AS position, "
    f"under_pressure, first_time, one_on_one, {', '.join(f'FALSE AS {c}' for c in _FLAGS)}, under_pressure AS has_freeze_frame, shot_fidelity_version IS NOT NULL AS high_fidelity_coordinates, coalesce({_VALID}, FALSE) AS has_valid_location, s.statsbomb_xg, is_goal AS goal "
    "FROM shots s JOIN matches m ON s.match_id = m.match_id WHERE NOT is_shootout"
)
def shot_dataset(t):
    return _dataset(t).withColumns({c: F.round(c, R) for c in ("shot_distance", "shot_angle")} | {"match_date": F.col("match_date").cast("string")})


@query(
    f"WITH d AS (SELECT *, {_VALID} AS v, CASE WHEN {_VALID} THEN {_GEO} END AS dist, CASE WHEN {_VALID} THEN degrees({_ANGLE}) END AS ang FROM shots WHERE NOT is_shootout) "
    "SELECT count(*) AS shots, count(*) FILTER (WHERE is_goal) AS goals, round(avg(is_goal::INT), 6) AS goal_rate, round(min(dist), 6) AS min_distance, round(avg(dist), 6) AS mean_distance, round(max(dist), 6) AS max_distance, round(min(ang), 6) AS min_angle, round(avg(ang), 6) AS mean_angle, round(max(ang), 6) AS max_angle, "
    "count(*) FILTER (WHERE NOT v) AS invalid_locations, count(*) FILTER (WHERE event_id IS NULL OR match_id IS NULL) AS null_keys, count(*) FILTER (WHERE dist < 0 OR dist > 126.49) AS bad_distances, count(*) FILTER (WHERE ang < 0 OR ang > 180) AS bad_angles, count(*) FILTER (WHERE v AND (dist IS NULL OR ang IS NULL)) AS missing_geometry, "
    "(SELECT count(*) FROM (SELECT event_id FROM d GROUP BY event_id HAVING count(*) > 1)) AS repeated_ids FROM d"
)
def sanity_report(t):
    return features.sanity_report(_dataset(t))


@query("WITH d AS (SELECT count(*) AS n, count(*) FILTER (WHERE shot_fidelity_version IS NULL) AS a, count(*) FILTER (WHERE stage IS NULL) AS b FROM matches) SELECT 'shot_fidelity_version' AS column, a AS missing, round(a / n, 6) AS share FROM d UNION ALL SELECT 'stage', b, round(b / n, 6) FROM d")
def missing_by_column(t):
    return features.missing_by_column(t("matches"), "shot_fidelity_version", "stage")


# -- exploration ------------------------------------------------------------------------------------------------------
@query("SELECT shot_type, count(*) AS shots, count(*) FILTER (WHERE is_goal) AS goals, round(count(*) FILTER (WHERE is_goal) / count(*), 6) AS goal_rate, round(count(*) * 100 / (SELECT count(*) FROM shots), 6) AS share_of_shots FROM shots GROUP BY shot_type")
def rate_table(t):
    return explore.rate_table(t("shots"), "shot_type")


@query("SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY event_type")
def event_shares(t):
    return explore.share_table(t("events"), "event_type")


def _flag_sql(f: str) -> str:
    return f"SELECT '{f}' AS flag, count(*) FILTER (WHERE {f}) AS true_count, round(count(*) FILTER (WHERE {f}) / count(*), 6) AS share, round(avg(is_goal::INT) FILTER (WHERE {f}), 6) AS rate_true, round(avg(is_goal::INT) FILTER (WHERE NOT {f}), 6) AS rate_false FROM shots"


@query(" UNION ALL ".join(map(_flag_sql, ("under_pressure", "first_time", "one_on_one"))))
def flag_table(t):
    return explore.flag_table(t("shots"), ["under_pressure", "first_time", "one_on_one"])


@query("SELECT shot_type, count(*) FILTER (WHERE outcome = 'A') AS A, count(*) FILTER (WHERE outcome = 'N') AS N, count(*) FILTER (WHERE outcome = 'R') AS R FROM shots GROUP BY shot_type")
def crosstab(t):
    return explore.crosstab(t("shots"), "shot_type", "outcome", ["A", "N", "R"])


@query("SELECT CASE WHEN grouping(shot_type) = 1 THEN 'All' ELSE shot_type END AS shot_type, CASE WHEN grouping(outcome) = 1 THEN 'All' ELSE outcome END AS outcome, count(*) AS n FROM shots GROUP BY CUBE (shot_type, outcome)")
def crosstab_margins(t):
    return explore.crosstab_margins(t("shots"), "shot_type", "outcome")


@query("SELECT least(floor((x - 60) / 2), 29)::BIGINT AS bin, count(*) AS n, least(floor((x - 60) / 2), 29)::BIGINT * 2.0 + 60 AS left_edge FROM shots WHERE x BETWEEN 60 AND 120 GROUP BY 1")
def hist1d(t):
    return explore.histogram(t("shots"), "x", 60.0, 120.0, 30)


@query("SELECT least(floor((x - 60) / 4), 14)::BIGINT AS cx, least(floor(y / 4), 19)::BIGINT AS cy, count(*) AS n, CASE WHEN count(*) >= 10 THEN round(avg(is_goal::INT), 6) END AS rate FROM shots WHERE x BETWEEN 60 AND 120 AND y BETWEEN 0 AND 80 GROUP BY 1, 2")
def hist2d_rate(t):
    return explore.grid_rates(t("shots"), "x", "y", "is_goal")


@query("SELECT CASE WHEN statsbomb_xg <= 0.05 THEN 0 WHEN statsbomb_xg <= 0.1 THEN 1 ELSE 2 END::BIGINT AS bin, count(*) AS n, round(avg(statsbomb_xg), 6) AS mean_score, round(avg(is_goal::INT), 6) AS rate FROM shots WHERE statsbomb_xg > 0 GROUP BY 1")
def calibration_bins(t):
    return explore.calibration_bins(t("shots"), "statsbomb_xg", "is_goal")


@query("WITH g AS (SELECT player_id, count(*) AS n FROM shots GROUP BY player_id), k AS (SELECT n, row_number() OVER (ORDER BY n DESC, player_id) AS r FROM g) SELECT sum(CASE WHEN r <= (SELECT count(*) // 20 FROM g) THEN n ELSE 0 END)::BIGINT AS top, sum(n)::BIGINT AS total, round(sum(CASE WHEN r <= (SELECT count(*) // 20 FROM g) THEN n ELSE 0 END) / sum(n), 6) AS share FROM k")
def top_share(t):
    return explore.top_share(t("shots").groupBy("player_id").agg(F.count("*").alias("n")), "n", "player_id")


@query("SELECT count(*) AS keys, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT count(*) AS n FROM shots GROUP BY player_id)")
def agg_of_agg(t):
    return explore.aggregate_of_counts(t("shots"), "player_id")


@query("WITH c AS (SELECT count(*) AS n FROM shots GROUP BY player_id) SELECT count(n) AS count, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS min, round(quantile_cont(n, 0.25), 6) AS p25, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.75), 6) AS p75, max(n) AS max FROM c")
def describe_counts(t):
    return explore.describe_counts(t("shots").groupBy("player_id").agg(F.count("*").alias("n")), "n")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS located, round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y FROM shots")
def located_range(t):
    return explore.located_range(t("shots"))


@query("SELECT (SELECT sum(total_goals)::BIGINT FROM matches) AS score_goals, count(*) FILTER (WHERE is_goal) AS shot_goals, (SELECT sum(total_goals)::BIGINT FROM matches) - count(*) FILTER (WHERE is_goal) AS difference FROM shots WHERE NOT is_shootout")
def reconciliation(t):
    return explore.reconciliation(t("matches"), t("shots"))


@query("SELECT stage, dense_rank() OVER (ORDER BY stage) - 1 AS code FROM (SELECT DISTINCT stage FROM matches)")
def factorize(t):
    return explore.codes(t("matches"), "stage")


@query("SELECT shot_fidelity_version, xy_fidelity_version, count(*) AS n FROM matches GROUP BY ALL")
def fidelity_counts(t):
    return t("matches").groupBy("shot_fidelity_version", "xy_fidelity_version").agg(F.count("*").alias("n"))


@query("SELECT team, period, round(avg(x), 6) AS mean_x FROM shots GROUP BY team, period")
def mean_by_team_period(t):
    return t("shots").groupBy("team", "period").agg(F.round(F.avg("x"), R).alias("mean_x"))


@query("SELECT player_id, count(DISTINCT body_part) AS levels FROM shots GROUP BY player_id HAVING count(DISTINCT body_part) > 1")
def spanning_groups(t):
    return explore.spanning(t("shots"), "player_id", "body_part")


@query("SELECT round(corr(quantity, price), 6) AS r FROM shots")
def correlation(t):
    return t("shots").agg(F.round(F.corr("quantity", "price"), R).alias("r"))


@query("SELECT player_id, body_part, count(*) AS n FROM shots GROUP BY ALL HAVING count(*) >= 10")
def frequent_pairs(t):
    return t("shots").groupBy("player_id", "body_part").agg(F.count("*").alias("n")).where("n >= 10")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_events(t):
    return windowed_counts(t("events"), "ts", "event_type")


@query("SELECT player_id, count(*) FILTER (WHERE is_goal) AS goals, count(*) AS shots, round((count(*) FILTER (WHERE is_goal) + 2.0) / (count(*) + 20.0), 6) AS shrunken_rate FROM shots GROUP BY player_id")
def shrunken_rates(t):
    g = t("shots").groupBy("player_id").agg(F.count_if("is_goal").alias("goals"), F.count("*").alias("shots"))
    return rounded(evaluate.shrunken_rates(g, "goals", "shots", 2.0, 18.0))


# -- descriptive statistics -------------------------------------------------------------------------------------------
_Q = ", ".join(f"round(quantile_cont(v, {q}), 6) AS p{int(q * 100):02d}" for q in describe.QUANTILES)


def _describe_sql(group: str) -> str:
    by, on = (f"GROUP BY {group}", f"USING ({group})") if group else ("", "ON TRUE")
    g = f"{group}, " if group else ""
    o = f"d.{group}, " if group else ""
    return f"""
WITH d AS (SELECT {g}price AS v FROM shots), a AS (SELECT {g}median(v) AS med, quantile_cont(v, 0.25) AS a1, quantile_cont(v, 0.75) AS a3 FROM d {by}),
b AS (SELECT {o}median(abs(v - med)) AS mad, count(*) FILTER (WHERE v < a1 - 1.5 * (a3 - a1) OR v > a3 + 1.5 * (a3 - a1)) AS n_outside_fences FROM d JOIN a {on} {by.replace(group, 'd.' + group) if group else ''}),
e AS (SELECT {o}count(*) FILTER (WHERE 0.6744897501960817 * abs(v - med) > 3.5 * b.mad) AS n_modified_z FROM d JOIN a {on} JOIN b {on} {by.replace(group, 'd.' + group) if group else ''}),
m AS (SELECT {g}count(*) AS n_total, count(v) AS n_observed, 0::BIGINT AS n_missing, 0::BIGINT AS n_infinite, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(var_samp(v), 6) AS variance, round(stddev_samp(v), 6) AS sd, round(min(v), 6) AS min, round(max(v), 6) AS max, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.75), 6) AS q3, round(skewness(v), 6) AS skewness, round(kurtosis(v), 6) AS kurtosis, round(stddev_samp(v) / sqrt(count(v)), 6) AS se, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, {_Q} FROM d {by})
SELECT m.*, round(b.mad, 6) AS mad, n_outside_fences, n_modified_z FROM m JOIN b {on} JOIN e {on}"""


@query(_describe_sql(""))
def describe_sample(t):
    return describe.describe_by_group(t("shots"), "price")


@query(_describe_sql("body_part"))
def describe_by_group(t):
    return describe.describe_by_group(t("shots"), "price", "body_part")


@query("WITH a AS (SELECT median(price) AS m FROM shots), b AS (SELECT median(abs(price - m)) AS d FROM shots, a) SELECT event_id, price, round(0.6744897501960817 * (price - m) / d, 6) AS modified_z FROM shots, a, b")
def modified_z(t):
    return rounded(describe.modified_z_scores(t("shots").select("event_id", "price"), "price"))


_K2 = """WITH m AS (SELECT count(price)::DOUBLE AS n, avg(price) AS m FROM shots), c AS (SELECT any_value(n) AS n, avg((price - m) ** 3) / avg((price - m) ** 2) ** 1.5 AS g1, avg((price - m) ** 4) / avg((price - m) ** 2) ** 2 - 3 AS g2 FROM shots, m),
s AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
  (g2 + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
  6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b FROM c),
a AS (SELECT *, 6 + 8 / b * (2 / b + sqrt(1 + 4 / (b * b))) AS a, y * sqrt((w2 - 1) / 2) AS u FROM s),
z AS (SELECT n, ln(u + sqrt(u * u + 1)) / sqrt(0.5 * ln(w2)) AS z1, (1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS z2 FROM a)
"""


@query(_K2 + "SELECT n::BIGINT AS n, round(z1, 4) AS z_skewness, round(z2, 4) AS z_kurtosis, round(z1 * z1 + z2 * z2, 3) AS k2, round(exp(-(z1 * z1 + z2 * z2) / 2), 5) AS p_value FROM z")
def dagostino_k2(t):
    k = describe.dagostino_k2(t("shots"), "price")
    return k.select("n", F.round("z_skewness", 4).alias("z_skewness"), F.round("z_kurtosis", 4).alias("z_kurtosis"), F.round("k2", 3).alias("k2"), F.round("p_value", 5).alias("p_value"))


@query()
def assess_normality(t):
    return describe.assess_normality(t("shots"), "price", "team")


@query("SELECT count(*) AS keys, count(*) FILTER (WHERE e) AS keys_with_all FROM (SELECT player_id, bool_and(coalesce(quantity < 40, false)) AS e FROM shots GROUP BY player_id)")
def keys_with_all(t):
    return explore.keys_with_all(t("shots"), "player_id", F.col("quantity") < 40)


@query(f"SELECT season_id, team, {DR.format('m1', 4)} AS mean_1, n1 AS n_1, {DR.format('m2', 4)} AS mean_2, n2 AS n_2 FROM (SELECT season_id, team, avg(quantity) FILTER (WHERE shot_type = 'Open Play') AS m1, count(quantity) FILTER (WHERE shot_type = 'Open Play') AS n1, avg(quantity) FILTER (WHERE shot_type = 'Penalty') AS m2, count(quantity) FILTER (WHERE shot_type = 'Penalty') AS n2 FROM shots GROUP BY ALL) WHERE n1 >= 5 AND n2 >= 5")
def phase_means(t):
    return rounded(explore.phase_means(t("shots"), "quantity", ["season_id", "team"], "shot_type", "Open Play", "Penalty"), 4)


# -- hypothesis tests -------------------------------------------------------------------------------------------------
_TWO = "WITH s AS (SELECT count(price) FILTER (WHERE outcome = 'A') AS n1, avg(price) FILTER (WHERE outcome = 'A') AS m1, var_samp(price) FILTER (WHERE outcome = 'A') AS v1, count(price) FILTER (WHERE outcome = 'R') AS n2, avg(price) FILTER (WHERE outcome = 'R') AS m2, var_samp(price) FILTER (WHERE outcome = 'R') AS v2 FROM shots) "


def _two(t) -> DataFrame:
    return hypothesis.two_samples(t("shots"), "price", "outcome", "A", "R")


@query(_TWO + "SELECT n1, n2, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6) AS t, (n1 + n2 - 2)::DOUBLE AS df, round(m1 - m2, 4) AS difference FROM s")
def student_t(t):
    return hypothesis.t_statistic(_two(t), equal_variance=True).select("n1", "n2", F.round("t", R).alias("t"), "df", F.round("difference", 4).alias("difference"))


@query(_TWO + "SELECT n1, n2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 3) AS df, round(m1 - m2, 4) AS difference FROM s")
def welch_t(t):
    return hypothesis.t_statistic(_two(t)).select("n1", "n2", F.round("t", R).alias("t"), F.round("df", 3).alias("df"), F.round("difference", 4).alias("difference"))


@query()
def welch_t_p_value(t):
    return hypothesis.t_test(_two(t))


_RANKED = "WITH o AS (SELECT quantity AS v, outcome AS g FROM shots WHERE outcome IN ('A', 'R')), k AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r FROM o) "


@query(_RANKED + ", s AS (SELECT count(*) FILTER (WHERE g = 'A') AS n1, count(*) FILTER (WHERE g = 'R') AS n2, sum(r) FILTER (WHERE g = 'A') AS r1 FROM k) SELECT n1, n2, r1 - n1 * (n1 + 1) / 2 AS u, round((r1 - n1 * (n1 + 1) / 2) / n1 / n2, 6) AS superiority, round(2 * (r1 - n1 * (n1 + 1) / 2) / n1 / n2 - 1, 6) AS rank_biserial FROM s")
def mann_whitney(t):
    m = hypothesis.mann_whitney(t("shots"), "quantity", "outcome", "A", "R")
    return m.select("n1", "n2", "u", F.round("superiority", R).alias("superiority"), F.round(2 * F.col("superiority") - 1, R).alias("rank_biserial"))


@query("WITH o AS (SELECT quantity AS v, outcome AS g FROM shots WHERE outcome IN ('A', 'R')), p AS (SELECT v, count(*) FILTER (WHERE g = 'A') AS a, count(*) FILTER (WHERE g = 'R') AS b FROM o GROUP BY v), c AS (SELECT sum(a) OVER (ORDER BY v) / (SELECT sum(a) FROM p) - sum(b) OVER (ORDER BY v) / (SELECT sum(b) FROM p) AS g FROM p) SELECT (SELECT sum(a) FROM p)::BIGINT AS n1, (SELECT sum(b) FROM p)::BIGINT AS n2, round(max(abs(g)), 6) AS d, round(max(g), 6) AS d_plus, round(max(-g), 6) AS d_minus FROM c")
def ks_2sample(t):
    return rounded(hypothesis.kolmogorov_smirnov(t("shots"), "quantity", "outcome", "A", "R").select("n1", "n2", "d", "d_plus", "d_minus"))


@query("WITH o AS (SELECT quantity AS v, outcome AS g FROM shots WHERE outcome IN ('A', 'R')), p AS (SELECT v, count(*) FILTER (WHERE g = 'A') AS a, count(*) FILTER (WHERE g = 'R') AS b FROM o GROUP BY v), c AS (SELECT sum(a) OVER (ORDER BY v) / (SELECT sum(a) FROM p) - sum(b) OVER (ORDER BY v) / (SELECT sum(b) FROM p) AS g FROM p) SELECT round(max(abs(g)), 6) AS d, round(max(g), 6) AS d_plus, round(max(-g), 6) AS d_minus FROM c")
def ecdf(t):
    return explore.ecdf_gap(t("shots"), "quantity", "outcome", "A", "R")


def _chi_sql(row: str, column: str, term: str, where: str = "TRUE") -> str:
    return f"""WITH o AS (SELECT {row} AS r, {column} AS c FROM shots WHERE {where}), cells AS (SELECT r, c, count(o.r) AS n FROM (SELECT DISTINCT r FROM o) a CROSS JOIN (SELECT DISTINCT c FROM o) b LEFT JOIN o USING (r, c) GROUP BY r, c),
e AS (SELECT n, sum(n) OVER (PARTITION BY r) * sum(n) OVER (PARTITION BY c) / sum(n) OVER () AS e, r, c FROM cells)
SELECT sum(n)::BIGINT AS n, (count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS dof, round(sum({term}), 6) AS chi2, round(sqrt(sum((n - e) ** 2 / e) / sum(n) / least(count(DISTINCT r) - 1, count(DISTINCT c) - 1)), 6) AS cramers_v FROM e"""


@query(_chi_sql("body_part", "outcome", "(n - e) ** 2 / e"))
def chi_square(t):
    return rounded(hypothesis.chi_square(t("shots"), "body_part", "outcome").select("n", "dof", "chi2", "cramers_v"))


@query(_chi_sql("under_pressure", "is_goal", "(abs(n - e) - least(0.5, abs(n - e))) ** 2 / e"))
def chi_square_yates(t):
    return rounded(hypothesis.chi_square(t("shots"), "under_pressure", "is_goal").select("n", "dof", "chi2", "cramers_v"))


_CELLS = "SELECT player_id, count(*) FILTER (WHERE is_goal) AS a, count(*) FILTER (WHERE NOT is_goal) AS b, (SELECT count(*) FILTER (WHERE is_goal) FROM shots) - count(*) FILTER (WHERE is_goal) AS c, (SELECT count(*) FILTER (WHERE NOT is_goal) FROM shots) - count(*) FILTER (WHERE NOT is_goal) AS d FROM shots GROUP BY player_id"


def _finishing(t, least: int = 1) -> DataFrame:
    """Each player's goals and misses against all others'."""
    s = t("shots")
    total = s.agg(F.struct(F.count_if("is_goal").alias("g"), F.count_if(~F.col("is_goal")).alias("m"))).scalar()
    own = s.groupBy("player_id").agg(F.count_if("is_goal").alias("a"), F.count_if(~F.col("is_goal")).alias("b")).where(F.col("a") + F.col("b") >= least).withColumn("t", total)
    return own.select("player_id", "a", "b", (F.col("t.g") - F.col("a")).alias("c"), (F.col("t.m") - F.col("b")).alias("d"))


_FISHER = f"""WITH cells AS ({_CELLS}), o AS (SELECT * FROM cells WHERE a + b >= 60), k AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS k FROM o),
p AS (SELECT *, exp(lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) + lgamma(c + d + 1) - lgamma(a + c - k + 1) - lgamma(c + d - a - c + k + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1)) AS p FROM k),
f AS (SELECT player_id, a, b, a * d / (b * c) AS odds_ratio, least(1.0, sum(p) FILTER (WHERE p <= q * (1 + 1e-7))) AS p_value FROM (SELECT *, max(p) FILTER (WHERE k = a) OVER (PARTITION BY player_id) AS q FROM p) GROUP BY ALL)"""


@query(_FISHER + " SELECT player_id, a, b, round(odds_ratio, 6) AS odds_ratio, round(p_value, 5) AS p_value FROM f")
def fisher_exact(t):
    f = hypothesis.fisher_exact(_finishing(t, 60))
    return f.select("player_id", "a", "b", F.round("odds_ratio", R).alias("odds_ratio"), F.round("p_value", 5).alias("p_value"))


@query(_FISHER + ", m AS (SELECT player_id, p_value, count(*) OVER () AS m, row_number() OVER (ORDER BY p_value, player_id) AS k FROM f) SELECT player_id, round(p_value, 5) AS p_value, round(least(1.0, p_value * m), 5) AS bonferroni, round(least(1.0, min(p_value * m / k) OVER (ORDER BY k DESC)), 5) AS benjamini_hochberg FROM m")
def finishing_family(t):
    f = hypothesis.fisher_exact(_finishing(t, 60)).select("player_id", "p_value")
    return rounded(multiplicity.adjust(f, key="player_id"), 5)


#: The reference's least number of shots. The SQL of the two queries above is fixed at 60, so the whole family has its own.
MIN_SHOTS = 15
_FISHER_ALL = _FISHER.replace("a + b >= 60", f"a + b >= {MIN_SHOTS}")


@query(_FISHER_ALL + " SELECT player_id, a, b, round(odds_ratio, 6) AS odds_ratio, round(p_value, 5) AS p_value FROM f")
def fisher_exact_all(t):
    f = hypothesis.fisher_exact(_finishing(t, MIN_SHOTS))
    return f.select("player_id", "a", "b", F.round("odds_ratio", R).alias("odds_ratio"), F.round("p_value", 5).alias("p_value"))


@query(_FISHER_ALL + ", m AS (SELECT player_id, p_value, count(*) OVER () AS m, row_number() OVER (ORDER BY p_value, player_id) AS k FROM f) SELECT player_id, round(p_value, 5) AS p_value, round(least(1.0, p_value * m), 5) AS bonferroni, round(least(1.0, min(p_value * m / k) OVER (ORDER BY k DESC)), 5) AS benjamini_hochberg FROM m")
def finishing_family_all(t):
    f = hypothesis.fisher_exact(_finishing(t, MIN_SHOTS)).select("player_id", "p_value")
    return rounded(multiplicity.adjust(f, key="player_id"), 5)


_FAMILY = "WITH f AS (SELECT c_custkey AS label, ((c_custkey * 37 + 11) % 1000 + 0.5) / 1000 AS p_value FROM customer) "


def _family(t) -> DataFrame:
    return t("customer").select(F.col("c_custkey").alias("label"), (((F.col("c_custkey") * 37 + 11) % 1000 + 0.5) / 1000).alias("p_value"))


@query(_FAMILY + "SELECT label, p_value::DOUBLE AS p_value, round(least(1.0, p_value * count(*) OVER ()), 6)::DOUBLE AS bonferroni FROM f")
def bonferroni(t):
    return rounded(multiplicity.adjust(_family(t)).select("label", "p_value", "bonferroni"))


@query(_FAMILY + ", k AS (SELECT *, row_number() OVER (ORDER BY p_value, label) AS k, count(*) OVER () AS m FROM f) SELECT label, round(least(1.0, min(p_value * m / k) OVER (ORDER BY k DESC)), 6)::DOUBLE AS benjamini_hochberg FROM k")
def benjamini_hochberg(t):
    return rounded(multiplicity.adjust(_family(t)).select("label", "benjamini_hochberg"))


@query(_FAMILY + "SELECT count(*) AS tests, count(*) FILTER (WHERE p_value <= 0.05) AS rejected_raw, count(*) FILTER (WHERE p_value * (SELECT count(*) FROM f) <= 0.05) AS rejected_bonferroni, round(count(*) * 0.05, 6)::DOUBLE AS expected_false FROM f")
def family_summary(t):
    return rounded(multiplicity.family_summary(multiplicity.adjust(_family(t))).select("tests", "rejected_raw", "rejected_bonferroni", "expected_false"))


_PAIRS = "WITH w AS (SELECT player_id, avg(price) FILTER (WHERE under_pressure) AS a, avg(price) FILTER (WHERE NOT under_pressure) AS b FROM shots GROUP BY player_id), d AS (SELECT a - b AS d FROM w WHERE a IS NOT NULL AND b IS NOT NULL)"


def _pairs(t) -> DataFrame:
    return t("shots").groupBy("player_id").agg(F.avg(F.when(F.col("under_pressure"), F.col("price"))).alias("a"), F.avg(F.when(~F.col("under_pressure"), F.col("price"))).alias("b"))


@query(_PAIRS + " SELECT count(*) AS n, round(avg(d), 4) AS difference, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, count(*) - 1 AS df FROM d")
def paired_t(t):
    return hypothesis.paired_t(_pairs(t), "a", "b").select("n", F.round("difference", 4).alias("difference"), F.round("t", R).alias("t"), "df")


@query("WITH w AS (SELECT player_id, count(*) FILTER (WHERE under_pressure) AS a, count(*) FILTER (WHERE NOT under_pressure) AS b FROM shots GROUP BY player_id), d AS (SELECT (a - b)::DOUBLE AS d FROM w), k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM d WHERE d <> 0) SELECT count(*) AS n, sum(r) FILTER (WHERE d > 0) AS w_plus, sum(r) FILTER (WHERE d < 0) AS w_minus, (SELECT median(d) FROM d) AS median_difference FROM k")
def wilcoxon(t):
    w = t("shots").groupBy("player_id").agg(F.count_if("under_pressure").cast("double").alias("a"), F.count_if(~F.col("under_pressure")).cast("double").alias("b"))
    return hypothesis.wilcoxon(w, "a", "b").select("n", "w_plus", "w_minus", "median_difference")


@query()
def mann_whitney_p_value(t):
    return hypothesis.mann_whitney(t("shots"), "quantity", "outcome", "A", "R")


@query()
def ks_p_value(t):
    return hypothesis.kolmogorov_smirnov(t("shots"), "quantity", "outcome", "A", "R")


@query()
def wilcoxon_p_value(t):
    return hypothesis.wilcoxon(_pairs(t), "a", "b")


_GROUPS = "WITH g AS (SELECT body_part, count(price) AS n, avg(price) AS mean, var_samp(price) AS v FROM shots GROUP BY body_part), t AS (SELECT sum(n * mean) / sum(n) AS m, sum(n) AS n FROM g) "


@query(_GROUPS + "SELECT count(*) AS k, any_value(t.n)::BIGINT AS n, round((sum(g.n * (mean - m) ** 2) / (count(*) - 1)) / (sum((g.n - 1) * v) / (any_value(t.n) - count(*))), 6) AS f FROM g, t")
def anova(t):
    return hypothesis.anova(hypothesis.group_statistics(t("shots"), "price", "body_part")).select("k", "n", F.round("f", R).alias("f"))


@query("WITH g AS (SELECT count(price) AS n, avg(price) AS mean, var_samp(price) AS v FROM shots GROUP BY body_part), w AS (SELECT *, n / v AS w FROM g), t AS (SELECT sum(w) AS sw, sum(w * mean) / sum(w) AS m FROM w), s AS (SELECT count(*) AS k, sum(w * (mean - m) ** 2) AS a, sum((1 - w / sw) ** 2 / (n - 1)) AS l FROM w, t) SELECT k, round((k * k - 1) / (3 * l), 3) AS df2, round((a / (k - 1)) / (1 + 2 * (k - 2) / (k * k - 1) * l), 6) AS f FROM s")
def welch_anova(t):
    return hypothesis.welch_anova(hypothesis.group_statistics(t("shots"), "price", "body_part")).select("k", F.round("df2", 3).alias("df2"), F.round("f", R).alias("f"))


@query("WITH k AS (SELECT body_part AS g, rank() OVER (ORDER BY quantity) + (count(*) OVER (PARTITION BY quantity) - 1) / 2 AS r FROM shots), s AS (SELECT count(*) AS n, sum(r) AS r FROM k GROUP BY g), c AS (SELECT sum(c * c * c - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM shots GROUP BY quantity)) SELECT count(*) AS k, sum(n)::BIGINT AS n, round((12 / (sum(n) * (sum(n) + 1)) * sum(r * r / n) - 3 * (sum(n) + 1)) / (1 - any_value(t) / (sum(n) ** 3 - sum(n))), 4) AS h FROM s, c")
def kruskal(t):
    return hypothesis.kruskal_wallis(t("shots"), "quantity", "body_part").select("k", "n", F.round("h", 4).alias("h"))


_EDGES = {"x": (72.0, 84.0, 96.0, 108.0), "y": (10.0, 35.0, 60.0)}


@query("WITH p AS (SELECT avg(is_goal::INT) AS p FROM shots), b AS (SELECT under_pressure::INT AS node, (CASE WHEN is_goal THEN 1.0 ELSE 0.0 END)::DOUBLE AS y, unnest([{'f': 0, 'b': (x >= 72)::INT + (x >= 84)::INT + (x >= 96)::INT + (x >= 108)::INT}, {'f': 1, 'b': (y >= 10)::INT + (y >= 35)::INT + (y >= 60)::INT}]) AS u FROM shots) SELECT node, u.f AS feature, u.b AS bin, round(sum(p - b.y), 6) AS g, round(sum(p * (1 - p)), 6) AS h, count(*) AS n FROM b, p GROUP BY ALL")
def gradient_histogram(t):
    """The sums that a boosted tree's second level is chosen from: by side of a first split, feature and bin."""
    shots = t("shots")
    base = shots.agg(F.ln(F.avg(F.col("is_goal").cast("int")) / (1 - F.avg(F.col("is_goal").cast("int"))))).scalar()
    bins = F.array(*[sum(((F.col(c) >= e).cast("int") for e in edges), F.lit(0)) for c, edges in _EDGES.items()])
    rows = shots.select(F.col("under_pressure").cast("int").alias("node"), F.col("is_goal").cast("double").alias("y"), bins.alias("b"))
    return rounded(boosting.gradient_histogram(rows, F.col("node"), base))


@query()
def bootstrap_median(t):
    """The reference's 10,000 replicates of the median price, over all rows."""
    return order_bootstrap.bootstrap_median(t("shots"), "price", resample.REPLICATES)


@query()
def bootstrap_trimmed_mean(t):
    return order_bootstrap.bootstrap_trimmed_mean(t("shots"), "price", 0.1, 1000)


@query()
def permutation_dealt(t):
    """The difference of mean prices of two halves of the players, whose labels are dealt anew in each replicate."""
    sums = resample.units(t("shots").withColumn("even", F.col("player_id") % 2 == 0), "price", "player_id", "even")
    return resample.permutation_dealt(sums, "even", True, resample.REPLICATES)


# -- effect sizes -----------------------------------------------------------------------------------------------------
@query(_TWO + "SELECT round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS cohens_d, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) * exp(lgamma((n1 + n2 - 2) / 2) - lgamma((n1 + n2 - 3) / 2)) / sqrt((n1 + n2 - 2) / 2), 6) AS hedges_g FROM s")
def cohens_d(t):
    return rounded(effects.cohens_d(_two(t)).select("cohens_d", "hedges_g"))


@query(f"WITH cells AS ({_CELLS}) SELECT player_id, round(a * d / (b * c), 6) AS odds_ratio, round(exp(ln(a * d / (b * c)) - 1.959963984540054 * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 4) AS low FROM cells WHERE a > 0 AND b > 0")
def odds_ratio(t):
    o = effects.odds_ratio(_finishing(t).where("a > 0 AND b > 0"))
    return o.select("player_id", F.round("odds_ratio", R).alias("odds_ratio"), F.round("low", 4).alias("low"))


@query(f"WITH cells AS ({_CELLS}), w AS (SELECT *, 1.959963984540054 AS z, a / (a + b) AS p1, c / (c + d) AS p2, a + b AS n1, c + d AS n2 FROM cells), i AS (SELECT *, (p1 + z * z / (2 * n1)) / (1 + z * z / n1) AS c1, z / (1 + z * z / n1) * sqrt(p1 * (1 - p1) / n1 + z * z / (4 * n1 * n1)) AS h1, (p2 + z * z / (2 * n2)) / (1 + z * z / n2) AS c2, z / (1 + z * z / n2) * sqrt(p2 * (1 - p2) / n2 + z * z / (4 * n2 * n2)) AS h2 FROM w) SELECT player_id, round(p1 - p2, 6) AS risk_difference, round(p1 - p2 - sqrt((p1 - c1 + h1) ** 2 + (c2 + h2 - p2) ** 2), 5) AS low, round(p1 - p2 + sqrt((c1 + h1 - p1) ** 2 + (p2 - c2 + h2) ** 2), 5) AS high FROM i")
def risk_difference(t):
    r = effects.risk_difference(_finishing(t))
    return r.select("player_id", F.round("risk_difference", R).alias("risk_difference"), F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


_V = _chi_sql("body_part", "outcome", "(n - e) ** 2 / e").replace("SELECT sum(n)::BIGINT AS n, (count", ", v AS (SELECT sum(n)::DOUBLE AS n, sum((n - e) ** 2 / e) / sum(n) AS phi, count(DISTINCT r) - 1 AS r, count(DISTINCT c) - 1 AS c FROM e) #").split("#")[0]


@query(_V + "SELECT n::BIGINT AS n, round(sqrt(greatest(0, phi - r * c / (n - 1)) / least(r - r * r / (n - 1), c - c * c / (n - 1))), 6) AS cramers_v FROM v")
def cramers_v_corrected(t):
    return rounded(effects.cramers_v(hypothesis.chi_square(t("shots"), "body_part", "outcome"), bias_correction=True))


@query()
def cramers_v_interval(t):
    return effects.cramers_v_interval(t("shots"), "body_part", "outcome")


@query()
def cohens_d_interval(t):
    return effects.cohens_d_interval(t("shots"), "price", "outcome", "A", "R", "event_id")


@query()
def conditional_odds_ratio(t):
    return effects.conditional_odds_ratio(_finishing(t, MIN_SHOTS))


_AB = "WITH c AS (SELECT player_id, count(*) FILTER (WHERE is_goal AND under_pressure) AS a, count(*) FILTER (WHERE NOT is_goal AND under_pressure) AS b, count(*) FILTER (WHERE is_goal AND NOT under_pressure) AS c, count(*) FILTER (WHERE NOT is_goal AND NOT under_pressure) AS d FROM shots GROUP BY player_id)"


def _pressed(t) -> DataFrame:
    """Each player's goals and misses under pressure and not."""
    side = lambda goal, pressed: F.count_if((F.col("is_goal") if goal else ~F.col("is_goal")) & (F.col("under_pressure") if pressed else ~F.col("under_pressure")))
    return t("shots").groupBy("player_id").agg(side(True, True).alias("a"), side(False, True).alias("b"), side(True, False).alias("c"), side(False, False).alias("d"))


@query(_AB + ", p AS (SELECT *, (a + c) / (a + b + c + d) AS q FROM c WHERE a + b > 0 AND c + d > 0) SELECT player_id, round(a / (a + b), 6) AS rate_1, round(c / (c + d), 6) AS rate_2, CASE WHEN q > 0 AND q < 1 THEN round((a / (a + b) - c / (c + d)) / sqrt(q * (1 - q) * (1 / (a + b) + 1 / (c + d))), 5) END AS z FROM p")
def two_proportion_z(t):
    z = proportions.two_proportion_z(_pressed(t).where("a + b > 0 AND c + d > 0"))
    return z.select("player_id", F.round("rate_1", R).alias("rate_1"), F.round("rate_2", R).alias("rate_2"), F.round("z", 5).alias("z"))


@query(
    _AB + ", k AS (SELECT *, unnest(range(0, c + 1)) AS i FROM c), p AS (SELECT player_id, a, b, c, d, sum(exp(lgamma(a + 1 + i) + lgamma(b + d + 2) - lgamma(a + b + d + 3 + i) - ln(d + 1 + i) - (lgamma(i + 1) + lgamma(d + 1) - lgamma(i + d + 2)) - (lgamma(a + 1) + lgamma(b + 1) - lgamma(a + b + 2)))) AS p FROM k GROUP BY ALL) "
    "SELECT player_id, round((a + 1) / (a + b + 2), 6) AS posterior_1, round((c + 1) / (c + d + 2), 6) AS posterior_2, round(p, 5) AS p_second_better FROM p"
)
def beta_binomial(t):
    b = proportions.beta_binomial(_pressed(t))
    return b.select("player_id", F.round("posterior_1", R).alias("posterior_1"), F.round("posterior_2", R).alias("posterior_2"), F.round("p_second_better", 5).alias("p_second_better"))


@query()
def lift_interval(t):
    teams = t("shots").groupBy("team").agg(*[F.count_if((F.col("is_goal") if g else ~F.col("is_goal")) & (F.col("under_pressure") if u else ~F.col("under_pressure"))).alias(n) for n, g, u in (("a", True, True), ("b", False, True), ("c", True, False), ("d", False, False))])
    return proportions.lift_interval(teams, "team")


# -- resampling -------------------------------------------------------------------------------------------------------
B = 100
_DRAW = "('0x' || substr(md5(concat_ws(':', '42', {})), 1, 8))::BIGINT"
_UNITS = "u AS (SELECT *, row_number() OVER (ORDER BY unit) - 1 AS pos FROM (SELECT player_id AS unit, count(price) AS n, sum(price) AS s1 FROM shots GROUP BY player_id))"


def _units(t, *strata: str) -> DataFrame:
    return resample.units(t("shots"), "price", "player_id", *strata)


@query(f"WITH {_UNITS}, m AS (SELECT count(*) AS m FROM u), d AS (SELECT r AS replicate, {_DRAW.format('r')} % m AS pos FROM m, range(1, {B + 1}) a(r), range(0, (SELECT count(*) FROM u)) b(s)) SELECT replicate::INT AS replicate, round(sum(s1) / sum(n), 4) AS mean FROM d JOIN u USING (pos) GROUP BY replicate")
def bootstrap_clusters(t):
    return rounded(resample.bootstrap_means(_units(t), B), 4)


@query(
    f"WITH u AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY unit) - 1 AS pos, count(*) OVER (PARTITION BY stage) AS m FROM (SELECT stage, player_id AS unit, count(price) AS n, sum(price) AS s1 FROM shots GROUP BY ALL)), "
    f"d AS (SELECT stage, r AS replicate, {_DRAW.format('r')} % m AS pos FROM u, range(1, {B + 1}) a(r)) SELECT replicate::INT AS replicate, round(sum(s1) / sum(n), 4) AS mean FROM d JOIN u USING (stage, pos) GROUP BY replicate"
)
def bootstrap_strata(t):
    return rounded(resample.bootstrap_means(_units(t, "stage"), B, strata=("stage",)), 4)


@query()
def compare_units(t):
    return resample.compare_resampling_units(t("shots"), "price", "event_id", "player_id")


@query(
    f"WITH u AS (SELECT player_id AS unit, max(player_id % 2) AS g, count(price) AS n, sum(price) AS s1 FROM shots GROUP BY player_id), k AS (SELECT r AS replicate, n, s1, row_number() OVER (PARTITION BY r ORDER BY {_DRAW.format('r')}, unit) <= (SELECT count(*) FROM u WHERE g = 1) AS a FROM u, range(1, {B + 1}) x(r)) "
    "SELECT replicate::INT AS replicate, round(sum(s1) FILTER (WHERE a) / sum(n) FILTER (WHERE a) - sum(s1) FILTER (WHERE NOT a) / sum(n) FILTER (WHERE NOT a), 4) AS difference FROM k GROUP BY replicate"
)
def permutation_clusters(t):
    u = resample.units(t("shots").withColumn("g", F.col("player_id") % 2), "price", "player_id", "g")
    return rounded(resample.permutation_differences(u, "g", 1, B), 4)


@query()
def permutation_summary(t):
    u = resample.units(t("shots").withColumn("g", F.col("player_id") % 2), "price", "player_id", "g")
    return resample.permutation_test(u, "g", 1, resample.REPLICATES)


@query()
def permutation_welch_t(t):
    u = resample.units(t("shots").withColumn("g", F.col("player_id") % 2), "price", "player_id", "g")
    return resample.permutation_test(u, "g", 1, resample.REPLICATES, statistic="welch_t")


# The SQL of three of the queries above is fixed at B replicates, so the reference's number has queries of its own.
@query()
def bootstrap_clusters_all(t):
    return rounded(resample.bootstrap_means(_units(t), resample.REPLICATES), 4)


@query()
def bootstrap_strata_all(t):
    return rounded(resample.bootstrap_means(_units(t, "stage"), resample.REPLICATES, strata=("stage",)), 4)


@query()
def permutation_clusters_all(t):
    u = resample.units(t("shots").withColumn("g", F.col("player_id") % 2), "price", "player_id", "g")
    return rounded(resample.permutation_differences(u, "g", 1, resample.REPLICATES), 4)


for _name in ("bootstrap_clusters", "bootstrap_strata", "permutation_clusters"):
    _keys = {"bootstrap_clusters": "r, s", "bootstrap_strata": "r, stage, pos", "permutation_clusters": "r, unit"}[_name]
    ORACLES[_name] = ORACLES[_name].replace("concat_ws(':', '42', r)", f"concat_ws(':', '42', {_keys})")
    ORACLES[f"{_name}_all"] = ORACLES[_name].replace(f"range(1, {B + 1})", f"range(1, {resample.REPLICATES + 1})")


# -- evaluation -------------------------------------------------------------------------------------------------------
_SCORED = "WITH o AS (SELECT is_goal::INT AS y, statsbomb_xg * 5 + 0.05 AS p FROM shots) "


def _scored(t) -> DataFrame:
    return t("shots").select(F.col("is_goal").alias("y"), (F.col("statsbomb_xg") * 5 + 0.05).alias("p"))


@query(
    _SCORED + ", k AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM o), s AS (SELECT count(*) AS n, sum(y) AS pos, sum(r) FILTER (WHERE y = 1) AS r FROM k), c AS (SELECT p, count(*) AS n, sum(y) AS pos FROM o GROUP BY p), "
    "a AS (SELECT sum(pos * cp / cn) / sum(pos) AS ap FROM (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(n) OVER (ORDER BY p DESC) AS cn FROM c)), l AS (SELECT avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS ll, avg((p - y) ** 2) AS br, avg(p) AS mp FROM o) "
    "SELECT n, pos::BIGINT AS positives, round(pos / n, 6) AS prevalence, round((r - pos * (pos + 1) / 2) / (pos * (n - pos)), 6) AS roc_auc, round(ap, 6) AS average_precision, round(ll, 6) AS log_loss, round(br, 6) AS brier, round(mp, 6) AS mean_prediction FROM s, a, l"
)
def probability_metrics(t):
    return rounded(evaluate.metrics(_scored(t), "y", "p").select("n", "positives", "prevalence", "roc_auc", "average_precision", "log_loss", "brier", "mean_prediction"))


@query(_SCORED + ", s AS (SELECT avg(y) AS v, avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS ll, avg((p - y) ** 2) AS br, avg(p) AS mp FROM o) SELECT round(1 - ll / -(v * ln(v) + (1 - v) * ln(1 - v)), 6) AS log_loss_skill, round(1 - br / (v * (1 - v)), 6) AS brier_skill, round(mp - v, 6) AS calibration_in_the_large FROM s")
def skill_scores(t):
    return rounded(evaluate.metrics(_scored(t), "y", "p").select("log_loss_skill", "brier_skill", "calibration_in_the_large"))


@query(_SCORED + ", c AS (SELECT p, count(*) AS n, sum(y) AS pos FROM o GROUP BY p), k AS (SELECT p, sum(n) OVER (ORDER BY p DESC) AS cn, sum(pos) OVER (ORDER BY p DESC) AS tp FROM c) SELECT round(p, 6) AS threshold, tp::BIGINT AS tp, (cn - tp)::BIGINT AS fp, round(tp / (SELECT sum(y) FROM o), 6) AS recall, round((cn - tp) / (SELECT sum(1 - y) FROM o), 6) AS false_positive_rate, round(tp / cn, 6) AS precision FROM k")
def roc_pr_curve(t):
    return rounded(evaluate.curve_points(_scored(t), "y", "p"))


@query(_SCORED + ", m AS (SELECT y, 'p' AS model, p FROM o UNION ALL SELECT y, 'half', 0.5 FROM o) SELECT model, count(*) AS n, round(avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss, round(avg((p - y) ** 2), 6) AS brier FROM m GROUP BY model")
def compare_models(t):
    return rounded(evaluate.compare_models(_scored(t).withColumn("half", F.lit(0.5)), "y", ["p", "half"]))


@query(
    _SCORED + ", m AS (SELECT y, 'p' AS model, p FROM o UNION ALL SELECT y, 'half', 0.5 FROM o), k AS (SELECT model, y, p, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2 AS r FROM m), "
    "s AS (SELECT model, count(*) AS n, sum(y) AS pos, sum(r) FILTER (WHERE y = 1) AS r, avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS ll, avg((p - y) ** 2) AS br FROM k GROUP BY model), c AS (SELECT model, p, count(*) AS n, sum(y) AS pos FROM m GROUP BY ALL), "
    "a AS (SELECT model, sum(pos * cp / cn) / sum(pos) AS ap FROM (SELECT model, pos, sum(pos) OVER (PARTITION BY model ORDER BY p DESC) AS cp, sum(n) OVER (PARTITION BY model ORDER BY p DESC) AS cn FROM c) GROUP BY model) "
    "SELECT model, n, round((r - pos * (pos + 1) / 2) / (pos * (n - pos)), 6) AS roc_auc, round(ap, 6) AS average_precision, round(ll, 6) AS log_loss, round(br, 6) AS brier FROM s JOIN a USING (model)"
)
def compare_model_metrics(t):
    return rounded(evaluate.compare_model_metrics(_scored(t).withColumn("half", F.lit(0.5)), "y", ["p", "half"]).select("model", "n", "roc_auc", "average_precision", "log_loss", "brier"))


@query("WITH g AS (SELECT DISTINCT match_id FROM shots), k AS (SELECT match_id, row_number() OVER (ORDER BY ('0x' || substr(md5(concat_ws(':', '42', match_id)), 1, 8))::BIGINT, match_id) AS k FROM g) SELECT match_id, k <= (SELECT ceil(count(*) * 0.25) FROM g) AS is_test FROM k")
def group_split(t):
    return evaluate.group_split(t("shots"), "match_id")


@query("WITH c AS (SELECT team, count(*) AS n FROM shots GROUP BY team), p AS (SELECT CASE WHEN n >= (SELECT sum(n) * 0.04 FROM c) THEN team ELSE 'infrequent' END AS level, sum(n)::BIGINT AS n FROM c GROUP BY 1) SELECT level, n, row_number() OVER (ORDER BY level) - 1 AS code FROM p")
def one_hot_pooled(t):
    return evaluate.one_hot_levels(t("shots"), "team", 0.04)


@query("SELECT event_id, price, round((price - (SELECT avg(price) FROM shots)) / (SELECT stddev_pop(price) FROM shots), 6) AS price_z FROM shots")
def standardize(t):
    return rounded(evaluate.standardize(t("shots").select("event_id", "price"), "price"))


@query("WITH d AS (SELECT o_orderkey, o_orderpriority, (o_orderstatus = 'F')::INT AS y, ('0x' || substr(md5(concat_ws(':', '42', o_orderkey)), 1, 8))::BIGINT AS h FROM orders) SELECT o_orderkey, round((coalesce(sum(y) OVER w, 0) + 0.5) / (count(y) OVER w + 1), 6) AS target_statistic FROM d WINDOW w AS (PARTITION BY o_orderpriority ORDER BY h, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def ordered_target_stat(t):
    d = t("orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    return rounded(evaluate.ordered_target_statistic(d, "o_orderpriority", "y", "o_orderkey", 0.5).select("o_orderkey", "target_statistic"))
