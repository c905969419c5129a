"""The strips and pieces that vectors meet in: every pair within reach once, in rows and tasks of bounded size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotloom.llm import embedding_dedup


@pytest.mark.parametrize("cuts", [[], [0.0], [-0.5, -0.45, 0.2, 0.9]])
def test_strips_within_reach_meet_once(cuts):
    x, reach = np.random.default_rng(2).normal(size=400), 0.3
    x[:4] = [-0.5, -0.45 + reach, 0.2 - reach, 0.9]
    strip = np.searchsorted(cuts, x, side="right")
    met = {}
    for p, q, rows in embedding_dedup.meetings(x, np.array(cuts), reach):
        met.setdefault((p, q), []).extend(rows)
    for i in range(len(x)):
        assert sum(i in rows for rows in met.values()) <= len(cuts) + 1  # before, (2^g + 1) / 2 copies, times the chunks of a cell
        for j in range(i):
            if abs(x[i] - x[j]) <= reach:
                p, q = sorted((strip[i], strip[j]))
                assert i in met[p, q] and j in met[p, q]


def test_pieces_hold_a_pair_once():
    rng = np.random.default_rng(3)
    y, reach = rng.normal(size=(1500, 3)).astype(np.float32), np.float32(0.4)
    seen = np.zeros((len(y), len(y)), int)
    for a, b in embedding_dedup._pieces(y, np.arange(900), np.arange(600, 1500), reach):
        seen[np.ix_(a, b)] += 1
    near = (np.abs(y[:, None] - y[None]) <= reach).all(2)
    assert seen.max() == 1 and seen[:900, 600:][near[:900, 600:]].all() and seen.sum() < 0.4 * 900 * 900


def test_trees_lose_no_link():
    rng = np.random.default_rng(4)
    for n, m in ((60, 40), (300, 280)):
        u, v, root = rng.integers(0, n, m), rng.integers(0, n, m), np.arange(n)
        for i in range(0, m, 7):
            embedding_dedup._unite(root, u[i : i + 7], v[i : i + 7])
        want = list(range(n))
        for _ in range(n):
            for a, b in zip(u, v, strict=True):
                want[a] = want[b] = min(want[a], want[b])
        assert embedding_dedup._root(root, np.arange(n)).tolist() == want


def test_vectors_travel_packed(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PACKED", 50)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(900, 16)).astype(np.float32)
    v[450:] = v[:450] + rng.normal(scale=0.1, size=(450, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, 1, x.tolist()) for i, x in enumerate(v)], "node long, n long, v array<float>")
    found = embedding_dedup.links(df, 0.95, chunk=200)
    plan = found._jdf.queryExecution().toString()
    assert "high" in plan  # before, a row a copy of a vector, and 10,000 vectors' copies in one batch
    got = found.groupBy("node").agg(F.sum("n_links").alias("n")).collect()
    x = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    want = (x @ x.T >= 0.95).sum(1) - 1
    assert {r.node: r.n for r in got} == {i: n for i, n in enumerate(want) if n}
