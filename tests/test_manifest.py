import json
import os

import pytest

from shotloom.sources import manifest
from shotloom.sources.raw import SourceError


def put(path, records, time=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(records if isinstance(records, str) else json.dumps(records))
    if time:
        os.utime(path, (time, time))


def lineup(team, *players):
    return {"team_id": team, "team_name": f"T{team}", "lineup": [{"player_id": p, "player_name": f"P{p}", "jersey_number": p} for p in players]}


def rows(spark, lake):
    return sorted((r.match_id, r.position, r.team_id, len(r.lineup)) for r in manifest.read_ingested(spark, lake, "lineups").collect())


def test_only_new_and_changed_files_are_read(spark, tmp_path):
    raw, lake = tmp_path / "raw", str(tmp_path / "lake")
    take = lambda: manifest.ingest(spark, f"{raw}/lineups/*.json", lake, "lineups")
    with pytest.raises(SourceError):
        take()
    with pytest.raises(SourceError):
        manifest.read_ingested(spark, lake, "lineups")
    put(raw / "lineups/11.json", [lineup(1, 5, 6), lineup(2, 7)], 1_700_000_000)
    put(raw / "lineups/12.json", "﻿\n [ ]", 1_700_000_000)
    assert take() == manifest.IngestSummary(2, 2, 2, 2)
    assert rows(spark, lake) == [(11, 0, 1, 2), (11, 1, 2, 1)]
    assert take() == manifest.IngestSummary(2, 0, 0, 0)  # nothing is read again
    put(raw / "lineups/13.json", [lineup(3, 9)], 1_700_000_000)
    os.utime(raw / "lineups/11.json", (1_700_000_500, 1_700_000_500))  # touched, not changed
    assert take() == manifest.IngestSummary(3, 2, 1, 1)
    assert take() == manifest.IngestSummary(3, 0, 0, 0)
    put(raw / "lineups/11.json", [lineup(1, 5, 6, 8)], 1_700_000_900)
    assert take() == manifest.IngestSummary(3, 1, 1, 1)
    assert rows(spark, lake) == [(11, 0, 1, 3), (13, 0, 3, 1)]
    put(raw / "lineups/13.json", [], 1_700_000_999)
    assert take() == manifest.IngestSummary(3, 1, 1, 0)
    assert rows(spark, lake) == [(11, 0, 1, 3)]


def test_a_batch_without_its_entries_is_not_seen(spark, tmp_path):
    raw, lake = tmp_path / "raw", str(tmp_path / "lake")
    put(raw / "lineups/1.json", [lineup(1, 5)])
    manifest.ingest(spark, f"{raw}/lineups/*.json", lake, "lineups")
    before = rows(spark, lake)
    # as if a run had died between its records and its entries
    spark.read.parquet(f"{lake}/_records/lineups/batch=1").write.parquet(f"{lake}/_records/lineups/batch=99")
    assert rows(spark, lake) == before
    put(raw / "lineups/2.json", '{"team_id": 1}')
    with pytest.raises(Exception, match="isn't a JSON array"):
        manifest.ingest(spark, f"{raw}/lineups/*.json", lake, "lineups")
    assert rows(spark, lake) == before
    put(raw / "lineups/2.json", [lineup(4, 1)])
    assert manifest.ingest(spark, f"{raw}/lineups/*.json", lake, "lineups").records == 1
    assert rows(spark, lake) == [*before, (2, 0, 4, 1)]


def test_first_matches_in_file_order(spark, tmp_path):
    raw, lake = tmp_path / "raw", str(tmp_path / "lake")
    put(raw / "matches/43/3.json", [{"match_id": m, "match_date": f"2018-06-{30 - k}"} for k, m in enumerate((9, 4, 7))])
    put(raw / "matches/55/43.json", [{"match_id": 1, "match_date": "2020-06-01"}])
    manifest.ingest(spark, f"{raw}/matches/*/*.json", lake, "matches")
    found = manifest.first_matches(manifest.read_ingested(spark, lake, "matches"), 2)
    assert [r.match_id for r in found.orderBy("file", "position").collect()] == [9, 4, 1]
    with pytest.raises(ValueError):
        manifest.first_matches(found, 0)


def test_argument():
    assert manifest.competition_season("43/3") == (43, 3)
    for bad in ("43", "a/3", "43/", ""):
        with pytest.raises(ValueError):
            manifest.competition_season(bad)
