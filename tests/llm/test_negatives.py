import numpy as np
import pytest

from shotloom.llm import hard_negatives as hn


def brute(rows, every=100, scale=256.0):
    """The contract by whole matrix products over rows (id, label, vector), each sound and of one length, as Python integers."""
    ids, labels = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    x = np.array([[int(np.floor(scale * c)) for c in r[2]] for r in rows], object)
    out = []
    for q in np.flatnonzero(ids % every == 0):
        score = x @ x[q]
        order = sorted(np.flatnonzero(ids != ids[q]), key=lambda j: (-score[j], ids[j]))
        for p in [j for j in order if labels[j] == labels[q]][:5]:
            fit = [j for j in order if labels[j] != labels[q] and 30 * score[p] <= 100 * score[j] <= 90 * score[p]][:10]
            out += [(int(ids[q]), int(ids[p]), k, int(ids[j]), int(score[p]), int(score[j])) for k, j in enumerate(fit, 1)]
    return sorted(out)


def vectors(n, dim, seed=3, labels=4, size=1.0, step=5):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(labels + 2, dim))
    return [(k * step, int(rng.integers(labels)), (size * (centers[rng.integers(labels + 2)] + rng.normal(size=dim))).tolist()) for k in range(n)]


def found(spark, rows, schema="id long, label int, v array<double>"):
    got = hn.mine(spark.createDataFrame(rows, schema).repartition(3))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("size", [1e-9, 0.1, 40.0, 1e5])
def test_like_brute_force(spark, size):
    rows = vectors(300, 12, size=size)
    want = brute(rows)
    assert found(spark, rows) == want
    assert size < 1e-3 or len(want) > 100


def test_ties_and_repeats(spark):
    rows = vectors(120, 3, size=0.01) + [(k, k % 3, [0.5, 0.25, -0.125]) for k in range(1000, 1400, 2)]
    rows += [(5000, 1, [1.0, 0.0, 0.0])] * 3 + [(5001, 1, [1.0, 0.0, 0.0])] * 2 + [(5002, 2, [0.6, 0.0, 0.0])] * 4
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = vectors(100, 4) + [(900_000, 1, [0.0] * 4), (-100, 2, [1.0, 2.0, -3.0, 0.5]), (900_100, 0, [-1.0] * 4)]
    other = [(7000 + k, k % 2, [1.0 + k, 0.5]) for k in range(0, 300, 50)]
    bad = [(None, 1, [1.0] * 4), (100, None, [1.0] * 4), (200, 1, None), (300, 1, []), (400, 1, [1.0, None, 0.0, 1.0]), (500, 1, [float("nan")] * 4), (600, 1, [float("inf"), 0.0, 0.0, 0.0])]
    wide = [(*r, "anchor", 3) for r in rows + other + bad]
    got = found(spark, wide, "id long, label int, v array<double>, kind string, pack int")
    assert got == sorted(brute(rows) + brute(other))


def test_empty_table(spark):
    assert found(spark, []) == []


def test_groups_and_packs(spark, monkeypatch):
    for name, n in (("PACK", 32), ("GROUP_ROWS", 64), ("GROUP_ANCHORS", 4), ("TILE", (4, 16))):
        monkeypatch.setattr(hn, name, n)
    rows = vectors(400, 8, seed=9, step=20)
    assert found(spark, rows) == brute(rows)


def test_pairs_are_dropped_early():
    rows = vectors(4000, 32, seed=1)
    ids, labels = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    ints = np.floor(256 * np.array([r[2] for r in rows])).astype(np.int64)
    planes, body = hn.to_planes(ints)
    raised = sum(np.unpackbits(body[k], axis=1, count=32).astype(np.int64) << (planes - 1 - k) for k in range(planes))
    assert (raised - (1 << (planes - 1)) == ints).all()
    ranges = hn.Ranges(np.arange(20), np.full(20, -hn.REACH), np.full(20, hn.REACH), 5)
    done = hn.sliced_search(body, 32, ids, labels, ints[:20], ids[:20], labels[:20], True, ranges)
    assert done < 0.2 * 20 * 4000 / 4
    for a in range(20):
        score = ints @ ints[a]
        best = sorted(((-score[j], ids[j]) for j in np.flatnonzero((labels == labels[a]) & (ids != ids[a]))))[:5]
        own = ranges.of == a
        assert [(-s, i) for s, i in zip(ranges.score[own], ranges.id[own], strict=True)] == best


def test_products_beyond_a_long():
    with pytest.raises(ValueError):
        planes, body = hn.to_planes(np.array([[2**40, 1]]))
        hn.sliced_search(body, 2, np.array([1]), np.array([1]), np.array([[2**40, 1]]), np.array([2]), np.array([1]), True, hn.Ranges(np.array([0]), np.array([0]), np.array([1]), 1))
