import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shotloom.operators import features, normalize, queries
from shotloom.schemas import DATASET_COLUMNS, TABLES
from shotloom.sources import raw, tables

REF = lambda i, n: {"id": i, "name": n}


def event(k, kind="Pass", **more):
    base = {"id": f"e{k}", "index": k, "period": 1, "timestamp": "00:00:01.000", "minute": 3, "second": 4, "type": REF(1, kind), "team": REF(10, "Reds"), "player": REF(7, "Ana B"), "location": [110.0, 40]}
    return {a: b for a, b in (base | more).items() if b is not None}


@pytest.fixture(scope="module")
def lake(tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    for d in ("matches/1", "events", "lineups"):
        (root / d).mkdir(parents=True)
    match = {"match_id": 51, "match_date": "2020-06-01", "competition": {"competition_id": 1, "competition_name": "Cup"}, "season": {"season_id": 2, "season_name": "2020"}, "home_team": {"home_team_id": 10, "home_team_name": "Reds"}, "away_team": {"away_team_id": 11, "away_team_name": "Blues"}, "home_score": 1, "away_score": 0}
    (root / "matches/1/2.json").write_text(json.dumps([match]))
    shot = {"statsbomb_xg": 0.3, "end_location": [120, 41.5], "outcome": REF(97, "Goal"), "body_part": REF(40, "Right Foot"), "technique": REF(93, "Normal"), "type": REF(87, "Open Play"), "freeze_frame": []}
    events = [event(1), event(2, "Shot", shot=shot), event(2, "Shot", shot=shot, minute=9), event(3, None and "x", type=None), event(4, "Shot", period=5, shot={"type": REF(88, "Penalty")}, location=None)]
    (root / "events/51.json").write_text(json.dumps(events))
    lineup = [{"team_id": 10, "team_name": "Reds", "lineup": [{"player_id": 7, "player_name": "Ana Beatriz", "player_nickname": "", "positions": [{"position": "LW"}]}, {"player_id": 8, "player_name": "Bo", "player_nickname": "B"}]}]
    (root / "lineups/51.json").write_text(json.dumps(lineup))
    return str(root)


@pytest.fixture(scope="module")
def built(spark, lake):
    return normalize.build_tables(raw.load_matches(spark, lake), raw.load_events(spark, lake), raw.load_lineups(spark, lake))


def test_counts_and_schemas(built):
    assert {k: v.count() for k, v in built.items()} == {"matches": 1, "events": 4, "shots": 2, "players": 2}
    for name, df in built.items():
        want = StructType.fromDDL(TABLES[name])
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in want]


def test_shot_semantics(built):
    goal, penalty = built["shots"].orderBy("event_id").collect()
    assert goal.is_goal and goal.has_freeze_frame and goal.minute == 3 and goal.end_z is None and not goal.first_time
    assert penalty.is_shootout and not penalty.is_goal and penalty.x is None and not penalty.has_freeze_frame


def test_players(built):
    a, b = built["players"].orderBy("player_id").collect()
    assert (a.display_name, a.matches_with_position, b.display_name, b.matches_with_position) == ("Ana Beatriz", 1, "B", 0)


def test_queries_and_features(built):
    rows = queries.player_conversion_rates(built["shots"], built["players"]).collect()
    assert [(r.player_id, r.shots, r.conversion_rate) for r in rows] == [(7, 1, 1.0), (8, 0, None)]
    data = features.build_shot_features(built["shots"], built["matches"])
    assert data.columns == list(DATASET_COLUMNS) and data.count() == 1
    # the contract, written out: a constant compared with itself would not see a slip
    assert data.columns == [
        *["shot_id", "match_id", "competition_id", "season_id", "team_id", "player_id", "player", "team", "match_date", "stage", "second"],
        *["shot_distance", "shot_angle", "x", "y", "minute", "period", "shot_type", "body_part", "technique", "play_pattern", "position"],
        *["under_pressure", "first_time", "one_on_one", "open_goal", "deflected", "aerial_won", "follows_dribble", "redirect"],
        *["has_freeze_frame", "high_fidelity_coordinates", "has_valid_location", "statsbomb_xg", "goal"],
    ]
    row = data.first()
    assert row.has_freeze_frame and row.has_valid_location and not row.high_fidelity_coordinates
    assert queries.shots_by_player(built["shots"], built["players"]).columns == ["player_id", "player", "team", "shots", "mean_statsbomb_xg"]
    assert queries.goals_by_player(built["shots"], built["players"]).columns == ["player_id", "player", "team", "goals", "shots"]
    assert queries.shots_by_team(built["shots"], built["matches"]).columns == ["team", "matches", "shots", "goals", "statsbomb_xg", "shots_per_match"]
    assert set(queries.player_conversion_rates(built["shots"], built["players"]).columns) == {"player_id", "player", "team", "squad_listings", "shots", "goals", "conversion_rate", "statsbomb_xg"}
    with pytest.raises(features.DatasetError):
        features.build_shot_features(built["shots"], built["matches"].limit(0))


def test_sources_refuse(spark, tmp_path):
    with pytest.raises(raw.SourceError):
        raw.load_competitions(spark, str(tmp_path))
    (tmp_path / "competitions.json").write_text('{"a": 1}')
    with pytest.raises(raw.SourceError, match="array"):
        raw.load_competitions(spark, str(tmp_path))
    with pytest.raises(tables.SourceError, match="build"):
        tables.read_table(spark, "shots", str(tmp_path))


def test_round_trip(built, spark, tmp_path):
    for name, df in built.items():
        summary = tables.write_table(df, name, str(tmp_path))
        assert summary.rows == df.count() and summary.bytes == sum(f.stat().st_size for f in (tmp_path / name).iterdir() if not f.name.startswith("."))
    tables.register_views(spark, str(tmp_path))
    assert spark.sql("SELECT count(*) FROM shots").first()[0] == 2


def test_feature_table(built, spark, tmp_path):
    from shotloom.operators import features

    with pytest.raises(tables.SourceError, match="build"):
        tables.read_shot_dataset(spark, str(tmp_path))
    data = features.build_shot_features(built["shots"], built["matches"])
    assert tables.write_shot_dataset(data, str(tmp_path)).rows == data.count()
    again = tables.read_shot_dataset(spark, str(tmp_path))
    assert again.columns == data.columns and again.collect() == data.collect()
    with pytest.raises(tables.SourceError, match="columns"):
        tables.write_shot_dataset(data.drop("goal"), str(tmp_path))


def test_ids_and_names_are_required(spark, lake, tmp_path):
    """A shot without a player or team fails, as do lineups without a name; the first of repeated events stays."""
    events = raw.load_events(spark, lake)
    for field in ("player", "team"):
        with pytest.raises(Exception, match=f"{field}.id is missing"):
            normalize.normalize_shots(events.withColumn(field, F.lit(None).cast(events.schema[field].dataType))).collect()
    assert {r.player_id: r.player_name for r in raw.player_names(raw.load_lineups(spark, lake)).collect()} == {7: "Ana Beatriz", 8: "B"}
    assert [r.match_id for r in raw.match_ids(raw.load_matches(spark, lake)).collect()] == [51]
    with pytest.raises(Exception, match="season_id is missing"):
        raw.competition_seasons(spark.createDataFrame([(1, None, "a", "b")], "competition_id long, season_id long, competition_name string, season_name string")).collect()
    assert models_refuse(["x", "goal"]) and models_refuse(["statsbomb_xg"]) and not models_refuse(["x", "under_pressure"])


def models_refuse(names):
    from shotloom.operators import models

    try:
        models.reject_leaky_features(names)
    except ValueError:
        return True
    return False
