"""The language model's classes of classes, windows and chunks against their definitions."""

import numpy as np
import pyarrow as pa
import pytest

from shotloom.llm import language_model as lm


def table(words: int) -> lm.Table:
    return lm.Table(10**6, words, 100, [(k, 10**6 // (k + 9)) for k in range(words)], np.ones(lm.BANDS, int), np.ones(lm.BANDS, int))


def steps(w: dict, doc: list[int]) -> float:
    """The natural log-likelihood of a document, word by word."""
    (groups, _, size), of = w["in"].shape, w["mid"].shape[2]
    h, out = np.zeros(lm.HIDDEN), 0.0
    for y in doc:
        c, levels = y // size, []
        if c < groups:
            levels = [(w["mid"][c // of], w["mid_b"][c // of], c % of), (w["in"][c], w["in_b"][c], y % size)]
        for weights, bias, k in [(w["out"], w["out_b"], c // of if c < groups else y - groups * size + len(w["mid"])), *levels]:
            z = h @ weights + bias
            z -= z.max()
            out += max(z[k] - np.log(np.exp(z).sum()), -69)
        to_gate, to_new = np.split(h @ w["state"], 2)
        h = h + (np.tanh(w["new"][y] + to_new) - h) / (1 + np.exp(-(w["gate"][y] + to_gate)))
    return out


def test_softmaxes_grow_as_the_cube_root_of_the_vocabulary():
    for words in (9000, 40000):
        groups, size = lm.class_shape(words)
        supers, of = lm.middle(groups)
        assert groups * size >= words and lm.class_shape(groups * size - size + 1)[0] >= supers * of - of
        w = lm.initial(table(words))
        assert w["in"].shape[0] == supers * of == groups
        width = sum(w[k].shape[-1] for k in w if k in ("out", "mid", "in"))
        assert width - lm.BANDS - 2 <= 5 * words ** (1 / 3) < 2 * words**0.5


def test_scores_with_classes_of_classes_are_those_of_single_steps():
    rng = np.random.default_rng(1)
    w = lm.initial(table(2000))
    for k in w:
        w[k] = w[k] + rng.normal(0, 0.2, w[k].shape).astype(np.float32)
    symbols = w["in_b"].size + lm.BANDS + 2
    docs = [rng.integers(0, symbols, n) for n in [1, 2, 130, 49, 48, 47, *rng.integers(1, 90, 250)]]
    got = lm.run_documents(w, docs, False)
    assert got == pytest.approx([steps(w, d.tolist()) for d in docs], rel=2e-3)


def test_large_logits_are_cut():
    w = lm.initial(table(2000))
    w["out_b"][0] += 200
    got = lm.run_documents(w, [np.array([0, 5, w["in_b"].size + 3])], False)
    assert np.isfinite(got).all() and got[0] < -50


def test_classes_of_classes_are_a_distribution_with_gradients():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in lm.initial(table(2000)).items()}
    kind = lm.class_of(table(2000).shape)
    n = len(kind)
    x, h = np.stack([np.full(n, 7), np.arange(n)]), lambda: np.zeros((n, lm.HIDDEN))
    score, first = lm.window(w, x, np.full(n, 2), h(), kind, False)[0], lm.window(w, x[:1], np.full(n, 1), h(), kind, False)[0]
    assert np.exp(score - first).sum() == pytest.approx(1)
    x, lengths, start = rng.integers(0, n, (7, 40)), np.repeat([7, 5, 2, 1], 10), lambda: np.zeros((40, lm.HIDDEN))
    grads = lm.window(w, x, lengths, start(), kind, True)[1]
    assert grads.keys() == w.keys()
    for name in w:
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        old, out = w[name][at], []
        for d in (1e-3, -1e-3):
            w[name][at] = old + d
            out.append(lm.window(w, x, lengths, start(), kind, False)[0].sum())
        w[name][at] = old
        assert -(out[0] - out[1]) / 2e-3 == pytest.approx(grads[name][at], rel=0.02)


def test_sums_of_rows():
    rng = np.random.default_rng(2)
    at = np.sort(np.concatenate([rng.integers(0, 300, 500), np.full(40, 7), np.full(lm.FEW, 301), np.full(lm.FEW + 1, 302)]))
    values = rng.normal(size=(len(at), 3))
    rows, one, two = lm._add_rows(at, values, 2 * values)
    assert sorted(rows) == sorted(set(at.tolist()))
    for k, a, b in zip(rows, one, two, strict=True):
        assert a == pytest.approx(values[at == k].sum(0)) and b == pytest.approx(2 * a)


def test_chunks_hold_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 10)
    sizes = [[3, 4, 5, 50], [], [1], [9, 1, 10, 11, 2]]
    batches = [pa.RecordBatch.from_pydict({"n_tokens": pa.array(s, pa.int64())}) for s in sizes]
    got = [t.column("n_tokens").to_pylist() for t in lm._chunks(iter(batches))]
    assert got == [[3, 4, 5], [50], [1, 9], [1, 10], [11], [2]]


def test_distinct_hashes_and_their_places():
    rng = np.random.default_rng(4)
    ends = np.array([5, 5, 0, 2**64 - 1, 2**64 - 1, 6], np.uint64)
    for hashes in (ends, ends[:0], ends[:1], np.arange(3000, dtype=np.uint64), rng.permutation(np.repeat(rng.integers(0, 2**63, 500, dtype=np.uint64), 9))):
        for n in (1, 5):
            own, place, part = lm._distinct(hashes, n)
            assert (own[place] == hashes).all() and len(own) == len(set(hashes.tolist()))
            assert n == 1 or (part == (own >> np.uint64(32)) % np.uint64(n)).all()
            assert sorted(zip(part.tolist(), own.tolist(), strict=True)) == list(zip(part.tolist(), own.tolist(), strict=True))
