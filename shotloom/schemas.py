"""Schemas of raw records and processed tables, and the column groups of the feature table."""

from __future__ import annotations

_REF = "struct<id:long,name:string>"

RAW = {
    "competitions": "competition_id long, season_id long, competition_name string, season_name string, competition_gender string, country_name string",
    "matches": "match_id long, match_date string, kick_off string, competition struct<competition_id:long,competition_name:string>, season struct<season_id:long,season_name:string>, home_team struct<home_team_id:long,home_team_name:string>, away_team struct<away_team_id:long,away_team_name:string>, home_score long, away_score long, match_week long, "
    f"competition_stage {_REF}, stadium {_REF}, referee {_REF}, metadata struct<shot_fidelity_version:string,xy_fidelity_version:string>",
    "events": f"id string, index long, period long, timestamp string, minute long, second long, type {_REF}, possession long, possession_team {_REF}, play_pattern {_REF}, team {_REF}, player {_REF}, position {_REF}, location array<double>, duration double, under_pressure boolean, out boolean, off_camera boolean, "
    f"shot struct<statsbomb_xg:double,end_location:array<double>,key_pass_id:string,outcome:{_REF},body_part:{_REF},technique:{_REF},type:{_REF},first_time:boolean,one_on_one:boolean,open_goal:boolean,deflected:boolean,aerial_won:boolean,follows_dribble:boolean,redirect:boolean,freeze_frame:array<struct<location:array<double>,player:{_REF},position:{_REF},teammate:boolean>>>",
    "lineups": "team_id long, team_name string, lineup array<struct<player_id:long,player_name:string,player_nickname:string,jersey_number:long,"
    f"country:{_REF},positions:array<struct<position_id:long,position:string,from:string,to:string>>>>",
}

PRIMARY_KEY = {"matches": "match_id", "events": "event_id", "shots": "event_id", "players": "player_id"}

SHOT_FLAGS = ("first_time", "one_on_one", "open_goal", "deflected", "aerial_won", "follows_dribble", "redirect")

TABLES = {
    "matches": "match_id long, competition_id long, season_id long, competition_name string, season_name string, kick_off string, stage_id long, stage string, match_week long, home_team_id long, home_team string, away_team_id long, away_team string, home_score long, away_score long, total_goals long, referee string, stadium string, shot_fidelity_version string, xy_fidelity_version string, match_date date",
    "events": "event_id string, match_id long, index long, period long, timestamp string, minute long, second long, type_id long, type string, possession long, possession_team string, play_pattern string, team_id long, team string, player_id long, player string, position string, x double, y double, duration double, under_pressure boolean, out boolean, off_camera boolean",
    "shots": "event_id string, match_id long, index long, period long, timestamp string, minute long, second long, team_id long, team string, player_id long, player string, position string, play_pattern string, x double, y double, end_x double, end_y double, end_z double, outcome_id long, outcome string, shot_type string, body_part string, technique string, statsbomb_xg double, key_pass_id string, is_goal boolean, is_shootout boolean, has_freeze_frame boolean, under_pressure boolean, "
    + ", ".join(f"{f} boolean" for f in SHOT_FLAGS),
    "players": "player_id long, player_name string, player_nickname string, display_name string, country string, team_id long, team string, squad_listings long, matches_with_position long",
}

# The feature table's column groups, in its order.
IDENTIFIERS = ("shot_id", "match_id", "competition_id", "season_id", "team_id", "player_id")
CONTEXT = ("player", "team", "match_date", "stage", "second")
NUMERIC = ("shot_distance", "shot_angle", "x", "y", "minute", "period")
CATEGORICAL = ("shot_type", "body_part", "technique", "play_pattern", "position")
BOOLEAN = ("under_pressure", *SHOT_FLAGS)
PROVENANCE = ("has_freeze_frame", "high_fidelity_coordinates", "has_valid_location")
BENCHMARK, TARGET = "statsbomb_xg", "goal"
DATASET_COLUMNS = (*IDENTIFIERS, *CONTEXT, *NUMERIC, *CATEGORICAL, *BOOLEAN, *PROVENANCE, BENCHMARK, TARGET)
#: Never features: the vendor's own probability, the target, and what is known only after the shot.
LEAKY = frozenset({"statsbomb_xg", "goal", "outcome", "outcome_id", "is_goal", "end_x", "end_y", "end_z"})
