from collections import defaultdict

import numpy as np
import pytest

from shotloom.llm import ann


def brute(rows, k=20, every=20):
    """{query: [[(score, id), ...] once for each of its rows]} over rows (id, vector) that are sound and of one length."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = defaultdict(list)
    for q in np.flatnonzero(ids % every == 0):
        score = np.einsum("ij,j->i", x, x[q])
        others = sorted((-score[j], int(ids[j])) for j in np.flatnonzero(ids != ids[q]))
        out[int(ids[q])].append([(-s, i) for s, i in others[:k]])
    return out


def found(spark, rows, schema="id long, v array<double>"):
    got = ann.nearest(spark.createDataFrame(rows, schema).repartition(3))
    assert got.columns == ["query_id", "rank", "id", "score"]
    out = defaultdict(list)
    for q, r, i, s in sorted(tuple(r) for r in got.collect()):
        out[q].append((r, i, s))
    return out


def same(got, want):
    assert got.keys() == {q for q, x in want.items() if x[0]}
    for q, lists in want.items():
        if lists[0]:
            rows = [(r, i) for x in lists for r, (_, i) in enumerate(x, 1)]
            assert [(r, i) for r, i, _ in got[q]] == sorted(rows)
            assert np.allclose(sorted(s for *_, s in got[q]), sorted(s for x in lists for s, _ in x), rtol=1e-12, atol=0)


def clustered(n, dim, clusters, seed=2, spread=0.3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, dim))
    return [(k, (centers[rng.integers(clusters)] + spread * rng.normal(size=dim)).tolist()) for k in range(n)]


def test_all_lists_is_exact(spark, monkeypatch):
    """With every list searched, shards cut small and norms of all sizes, the result is brute force's."""
    monkeypatch.setattr(ann, "measure_ratio", lambda *a: 1e9)
    monkeypatch.setattr(ann, "SHARD_ROWS", 100)
    monkeypatch.setattr(ann, "QUERY_ROWS", 7)
    rng = np.random.default_rng(4)
    rows = [(k, (np.array(v) * rng.choice((0.01, 1, 30))).tolist()) for k, v in clustered(700, 6, 9)]
    # one list is larger than a shard
    rows += [(700 + k, [1 + 1e-4 * k, 1.0, 0.0, 0.0, 0.0, 0.0]) for k in range(300)]
    same(found(spark, rows), brute(rows))


def test_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "measure_ratio", lambda *a: 1e9)
    rows = clustered(200, 4, 5) + [(k, [0.5, 0.5, -0.5, 0.5]) for k in range(1000, 1200)] + [(k, [0.0, 0.5, 0.0, 0.0]) for k in range(1200, 1230)] + [(k, [0.0, 0.5, 0.25, 0.0]) for k in range(1230, 1260)]
    rows += [(2000, [3.0, 0.0, 0.0, 0.0])] * 3 + [(2001, [3.0, 0.0, 0.0, 0.0])] * 2
    same(found(spark, rows), brute(rows))


def test_recall_and_share_of_lists(spark):
    rows = clustered(6000, 24, 40)
    want, got = brute(rows), found(spark, rows)
    hits = sum(len({i for _, i in want[q][0]} & {i for _, i, _ in got[q]}) for q in want)
    assert hits >= 0.95 * 20 * len(want)
    assert all([r for r, *_ in got[q]] == list(range(1, 21)) for q in want)
    x = {k: np.array(v) for k, v in rows}
    assert all(abs(x[q] @ x[i] - s) < 1e-9 for q in got for _, i, s in got[q])
    nodes = spark.createDataFrame([(k, [k], v) for k, v in rows], "node long, ids array<long>, v array<double>")
    index = ann.fit(nodes)
    posted = ann.post(nodes, index).cache()
    lists = [r["lists"] for r in posted.collect()]
    assert all(1 <= len(x) <= ann.REPLICAS and len(set(x)) == len(x) for x in lists) and sum(map(len, lists)) > len(lists)
    ratio = ann.measure_ratio(posted, nodes.where("node % 20 = 0"), index, 20)
    searched = ann.Index(index.radius, index.centroids, index.graph, ratio).search(np.array([v for _, v in rows[::20]]))
    assert np.mean([len(x) for x in searched]) < 0.35 * len(index.centroids)


def test_walk_finds_what_a_scan_finds():
    rng = np.random.default_rng(8)
    c = rng.normal(size=(900, 10)).astype(np.float32)
    index = ann.Index(1.0, c, ann.centroid_graph(c), 1.3)
    v = rng.normal(size=(300, 9))
    d = ann._squares(index.queries(v), c)
    scan = [set(np.flatnonzero(x <= index.ratio**2 * x.min() * (1 + 1e-6))) for x in d]
    walk = [set(x) for x in index.search(v)]
    assert sum(len(a & b) for a, b in zip(scan, walk, strict=True)) >= 0.98 * sum(map(len, scan))


def test_balanced():
    x = np.random.default_rng(1).normal(size=(1003, 5)).astype(np.float32) ** 3
    c = ann.balanced_centroids(x, 37)
    assert c.shape == (37, 5)
    assert len(ann.balanced_centroids(x[:4], 9)) == 4
    first, pieces = ann.shards({0: 5, 1: 40_000, 2: 16_000, 3: 384, 4: 1}, 5)
    assert first.tolist() == [0, 1, 4, 4, 5] and pieces.tolist() == [1, 3, 1, 1, 1]


def test_odd_rows(spark):
    rows = clustered(90, 3, 4) + [(100_000, [1e150, -1e150, 0.0]), (100_020, [1e-200, 0.0, 0.0]), (-40, [0.0, -0.0, 2.0])]
    bad = [(None, [1.0, 2.0, 3.0]), (20, None), (40, []), (60, [0.0, -0.0, 0.0]), (80, [1.0, None, 2.0]), (100, [float("nan"), 1.0, 1.0]), (120, [float("inf"), 1.0, 1.0])]
    bad = [(i if i is None else i + 200_000, v) for i, v in bad]
    other = [(300_000 + 20 * k, [1.0 + k, 2.0]) for k in range(3)] + [(400_000, [5.0])]
    got = found(spark, [(*r, "node", 1) for r in rows + bad + other], "id long, v array<double>, k1 string, node int")
    want = brute(rows) | brute(other[:3])
    same(got, want)
    assert 400_000 not in got


def test_floats_and_empty(spark):
    rows = [(k, np.float32(v).tolist()) for k, v in clustered(60, 8, 3)]
    same(found(spark, rows, "id int, v array<float>"), brute(rows))
    assert ann.nearest(spark.createDataFrame([], "id long, v array<float>")).count() == 0


@pytest.mark.parametrize("n", [1, 2])
def test_few_rows(spark, n):
    rows = [(20 * k, [1.0, float(k)]) for k in range(n)]
    same(found(spark, rows), brute(rows))
