import pytest

from shotloom.service import NotFoundError, Service
from shotloom.sources import tables

from .test_normalize import built, lake  # noqa: F401


def test_endpoints(spark, built, tmp_path):  # noqa: F811
    for name, df in built.items():
        tables.write_table(df, name, str(tmp_path))
    s = Service(spark, str(tmp_path))
    assert s.health() == {"status": "ok"}
    assert s.summary() == {"matches": 1, "players": 2, "shots": 1, "goals": 1, "goal_rate": 1.0}
    page = s.matches(limit=5)
    assert page["total"] == 1 and page["items"][0]["match_id"] == 51
    with pytest.raises(ValueError, match="limit"):
        s.matches(limit=0)
    shots = s.match_shots(51)["shots"]
    assert len(shots) == 1 and shots[0]["probability"] is None and shots[0]["outcome"] == "Goal"
    with pytest.raises(NotFoundError):
        s.match_shots(52)
    with pytest.raises(ValueError, match="pitch"):
        s.predict_shot("m", 130, 1)
    assert s.statistics()["by_body_part"][0]["body_part"] == "Right Foot"
