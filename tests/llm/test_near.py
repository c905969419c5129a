import random
from collections import Counter

import numpy as np
import pytest

from shotloom.llm import embedding_dedup, minhash
from shotloom.llm.components import connected_components

from .conftest import prose


def shingles(text):
    w = (text or "").encode().split()
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def alike(a, b):
    """Probability Jaccard similarity of two texts' shingle counts."""
    x, y = Counter(a), Counter(b)
    every = set(x) | set(y)
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in every) for i in set(x) & set(y))


def classes(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("limit", [200_000, 0, 25])
def test_components(spark, limit):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 120)] + [(rng.randint(200, 230), rng.randint(200, 230)) for _ in range(12)] + [(5, 5), (7, 8), (7, 8), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), task_edges=limit).collect()}
    ids = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    own = {frozenset(e) for e in edges}
    assert got == classes(sorted(ids), lambda i, j: frozenset((i, j)) in own)


@pytest.mark.parametrize("chunk", [minhash.CHUNK, 3])
def test_near_duplicates(spark, chunk):
    rng, rows = random.Random(8), []
    for g in range(6):
        base = prose(g, 80).split()
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"w{rng.randint(0, 99)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "a  b"), (905, prose(77, 50) + "\n" + prose(0, 30)), (906, rows[3][1]), (906, rows[3][1]), (907, prose(0, 80) * 9)]
    df = spark.createDataFrame([*[(*r, "x", 1) for r in rows], (None, rows[0][1], "y", 1)], "doc_id long, text string, kept string, near_id int").repartition(3)
    text = dict(rows)
    s = {i: shingles(t) for i, t in text.items()}
    want = classes(sorted(text), lambda i, j: bool(s[i]) and bool(s[j]) and alike(s[i], s[j]) >= 0.8)
    got = minhash.near_duplicates(df, chunk=chunk).collect()
    assert len(got) == df.count()
    for r in got:
        assert r.class_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is None or r.doc_id == r.class_id)
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))


def test_near_duplicates_of_nothing(empty):
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.keep_one(empty).count() == 0


def test_repeated_ids_of_other_texts(spark):
    """A text is not lost because its id belongs to another one too."""
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(1, a, 10), (5, b, 20), (5, a + " extra", 30), (7, c, 40), (7, c, 41), (8, " " + c, 50), (9, b + " more", 60), (9, None, 70), (9, None, 71), (None, a, 80), (None, a, 81)]
    df = spark.createDataFrame(rows, "doc_id long, text string, near_id int")
    got = sorted((r.doc_id or 0, r.class_id or 0, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(0, 0, True), (0, 0, True), (1, 1, True), (5, 1, False), (5, 5, True), (7, 7, True), (7, 7, True), (8, 7, False), (9, 5, False), (9, 9, True), (9, 9, True)]
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    left = sorted(r.near_id for r in kept.collect())
    assert left in ([10, 20, x, y, 80, 81] for x in (40, 41) for y in (70, 71))


def test_similarity_of_weighted_sets():
    rng = np.random.default_rng(4)
    for weighted in (False, True):
        for _ in range(20):
            sets = []
            for _ in range(2):
                items = np.unique(rng.integers(1, 40, 25)).astype(np.uint64)
                sets.append((items, rng.integers(1, 5, len(items)).astype(float) if weighted else None))
            texts = [[k for k, n in zip(i.tolist(), w if w is not None else [1] * len(i), strict=True) for _ in range(int(n))] for i, w in sets]
            assert abs(minhash.similarity(*sets) - alike(*texts)) < 1e-9


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    a, b = rng.integers(1, 9, 60).astype(float), rng.integers(1, 9, 60).astype(float)
    a[:15], b[45:] = 0, 0
    item = np.arange(1, 61, dtype=np.uint64)
    doc = np.repeat([0, 1], [45, 45])
    sig = minhash.signatures(doc, np.concatenate([item[a > 0], item[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 4096)
    both = (a > 0) & (b > 0)
    want = sum(1 / np.maximum(a / a[k], b / b[k]).sum() for k in np.flatnonzero(both))
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


@pytest.mark.parametrize("chunk", [16_384, 7])
def test_embeddings(spark, chunk, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 64)).astype(np.float32)
    near = v[:20].repeat(3, 0) + rng.normal(scale=0.15, size=(60, 64)).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([v, near, v[:5], 2 * v[:5]]))]
    rows += [(500, None), (501, []), (502, [0.0] * 64), (503, [float("nan")] * 64), (504, [None] + [1.0] * 63), (505, [float("inf")] + [1.0] * 63), (506, [1.0, 2.0]), (507, [2.0, 4.0]), (None, v[0].tolist())]
    df = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<float>, n_links string").repartition(3)
    if chunk < 100:
        own = embedding_dedup.links
        monkeypatch.setattr(embedding_dedup, "links", lambda d, t: own(d, t, chunk=chunk))
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    sound = {i: np.array(x, float) / np.linalg.norm(np.array(x, float)) for i, x in rows if i is not None and x and None not in x and np.isfinite(x).all() and any(x)}
    linked = lambda i, j: i in sound and j in sound and len(sound[i]) == len(sound[j]) and sound[i] @ sound[j] >= 0.95
    ids = [i for i, _ in rows if i is not None]
    want = classes(ids, linked)
    for i in ids:
        assert got[i].n_links == sum(linked(i, j) for j in ids if j != i), i
        assert got[i].component_id == want[i] and got[i].kept == (want[i] == i)
    assert got[None].n_links == 0 and got[None].kept
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_one_id_and_doubles(spark):
    """Rows of one id with other vectors don't merge; doubles beyond a float's range link."""
    x, y, z = np.eye(8)[0] * 1e39, np.eye(8)[1] * 1e300, np.eye(8)[2]
    rows = [(7, x), (7, y), (8, 2 * x), (9, 3 * y), (10, y / 7), (11, z), (11, z)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [(7, 1, 7), (7, 2, 7), (8, 1, 7), (9, 2, 7), (10, 2, 7), (11, 1, 11), (11, 1, 11)]
