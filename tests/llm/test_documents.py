import math
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shotloom.llm import classifier, html_extract, language_model, minhash, quality_rules, queries, storage
from shotloom.llm.html_pages import labelled_page
from shotloom.llm.words import mix, words_of

from .conftest import ODD, prose


def test_rules_against_sql(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    rows += [(50, "a b c d e " * 30), (51, "x y\nx y\n\nx y\n z"), (52, "WORD!! LOUD!! " * 20), (53, "a | b | " * 10), (54, prose(5, 60)), (55, "a b c d e f a b c d e a b c d e q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents_", df.toPandas().astype({"doc_id": "Int64"}))
    con.execute("CREATE VIEW documents AS SELECT doc_id, text FROM documents_")
    want = con.execute(queries.OP5_SQL).fetchall()
    names = [d[0] for d in con.description]
    rows = quality_rules.apply_policy(quality_rules.ledger(df))
    from pyspark.sql import functions as F

    got = rows.withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(3)) != 0).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert quality_rules.ledger(df.limit(0)).count() == 0


def test_rule_filter_and_ablation(spark, odd):
    led = quality_rules.apply_policy(quality_rules.ledger(odd))
    kept = quality_rules.filter_documents(odd)
    assert kept.columns == odd.columns and kept.count() == led.where("kept").count()
    rows = {r.rule: r for r in quality_rules.ablation(led).collect()}
    assert rows["few_words"].n_failed == led.where("n_words < 10").count()


def test_classifier_on_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.fit(docs, classifier.learnable(labels))
    rows = classifier.score(docs, model, "doc_id").join(labels, "doc_id").toPandas()
    held = rows[[zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]]
    good, bad = held.score[held.quality == 1].values, held.score[held.quality == 0].values
    assert np.mean([(good > b).mean() for b in bad]) > 0.99
    assert classifier.filter_documents(docs, model).columns == docs.columns


def test_classifier_features_are_those_of_single_words(monkeypatch):
    """Pooling, tiles and batches against the definition, word by word; the scores against plain layers."""
    monkeypatch.setattr(classifier, "TILE", 7)
    rng, index = np.random.default_rng(4), classifier.index_vectors()
    vectors = classifier.word_vectors(index, rng.normal(size=(classifier.BUCKETS, classifier.DIM)).astype(np.float32))
    texts = [(t or "").encode() for t in ODD] + [b"a", b"na na na na na", b"one two " * 30]
    got, n = classifier.pooled(texts, vectors), classifier.DIM

    def bucket(value, seed):
        return int(mix(np.array([value | seed << 32], np.uint64))[0] % np.uint64(classifier.BUCKETS))

    for text, row in zip(texts, got, strict=True):
        words = re.findall(rb"[^ \t-\r]+", text)
        own = [int(words_of([x]).hash[0] % np.uint64(classifier.BUCKETS)) for x in words]
        want = np.zeros(4 * n + 1)
        for x, k in zip(words, own, strict=True):
            want[: 2 * n] += vectors[k]
            for value, seed in ((x[0], 1), (x[-1], 2), (x[-2:][0] << 8 | x[-1], 3)):
                want[2 * n : 3 * n] += index[bucket(value, seed)]
        for a, b in zip(own, own[1:]):
            want[3 * n : 4 * n] += index[a] * index[b]
        want[:-1] /= max(1, len(words))
        want[-1] = math.log1p(len(words)) / 4
        assert np.allclose(row, want, atol=1e-4)

    layers = [rng.normal(size=s) for s in ((4 * n + 1, 5), 5, (5, 1), 1)]
    model = classifier.Model(vectors, tuple(layers), 1.7, 0.5, (got.mean(0), got.std(0) + 1e-6))
    for x, s in zip(got, model.scores(texts), strict=True):
        hidden = np.tanh((x - model.scale[0]) / model.scale[1] @ layers[0] + layers[1])
        assert s == pytest.approx(1 / (1 + math.exp(-float(hidden @ layers[2][:, 0] + layers[3][0]) / 1.7)), abs=1e-4)
    # what stands beside a text doesn't change its row
    assert all((classifier.pooled([t], vectors)[0] == row).all() for t, row in zip(texts, got, strict=True))


def test_classifier_defined_cases(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    model = classifier.fit(odd, labels)
    assert model.layers is None and {r.score for r in classifier.score(odd, model, "doc_id").collect()} == {1.0}
    assert classifier.score(empty, classifier.fit(empty, labels.limit(0)), "doc_id").count() == 0


def test_extraction_of_labelled_pages():
    learned, exact = html_extract.weights(), 0
    for seed in range(5000, 5100):
        page = labelled_page(seed)
        want = "\n".join(" ".join(t.split()) for _, t, c in page if c)
        exact += html_extract.extract("".join(h + (t or "") for h, t, _ in page), learned) == want
    assert exact >= 95


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<html><nav><a href=x>Home</a></nav></html>", ""),
        ("<body><article><h1>A &amp; B</h1><p>One<br>two  <b>three</b><p>Four &lt;i&gt;</article><footer>&copy; x</footer>", "A & B\nOne two three\nFour <i>"),
        ("<article><p>One two three.</p><script>var a='</p><p>no';</script><div class='ad'>Buy it now</div><p>Four five six.</article>", "One two three.\nFour five six."),
        ("<article><p>An end without", "An end without"),
    ],
)
def test_extraction_cases(page, want):
    assert html_extract.extract(page, html_extract.weights()) == want


def test_extraction_table(spark):
    df = spark.createDataFrame([(1, "<article><p>Some text here.</p></article>", "t"), (1, None, None)], "page_id long, html string, text string")
    assert sorted(r.text for r in html_extract.extract_pages(df, "page_id").collect()) == ["", "Some text here."]


def test_language_model(spark, odd, empty):
    rows = [(k, prose(k, 30 + k % 50)) for k in range(200)] + [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is None]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(2)
    got = language_model.score_documents(df).collect()
    tokens = {i: [*(t or '').encode().lower().split(), None] for i, t in rows}
    count = Counter(x for i, t in tokens.items() if not language_model.held_out(i) for x in t)
    n, v = sum(count.values()), len(count)
    for r in got:
        own = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(x in count for x in own), n)
        assert r.base_score == pytest.approx(sum(np.log10((count[x] + 1) / (n + v + 1)) for x in own))
        assert r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 1.05
    assert language_model.score_documents(empty).count() == 0


def test_scores_are_those_of_single_steps():
    """Lanes, windows and classes against the model's definition, token by token."""
    rng = np.random.default_rng(1)
    t = language_model.Table(100, 5, 10, [(1, 50), (2, 20)], np.ones(language_model.BANDS, int), np.ones(language_model.BANDS, int))
    w, kind = language_model.initial(t), language_model.class_of()
    for k in w:
        w[k] = w[k] + rng.normal(0, 0.2, w[k].shape).astype(np.float32)
    docs = [rng.integers(0, language_model.SYMBOLS, n) for n in [1, 2, 5, 130, 49, 48, 47, *rng.integers(1, 90, 220)]]
    got = language_model.run_documents(w, docs, False)
    size = w["in"].shape[2]
    for d, score in zip(docs, got, strict=True):
        h, want = np.zeros(language_model.HIDDEN), 0.0
        for y in d.tolist():
            z = h @ w["out"] + w["out_b"]
            want += z[kind[y]] - np.log(np.exp(z).sum())
            if kind[y] < len(w["in"]):
                z = h @ w["in"][kind[y]] + w["in_b"][kind[y]]
                want += z[y - kind[y] * size] - np.log(np.exp(z).sum())
            to_gate, to_new = np.split(h @ w["state"], 2)
            h = h + (np.tanh(w["new"][y] + to_new) - h) / (1 + np.exp(-(w["gate"][y] + to_gate)))
        assert score == pytest.approx(want, rel=1e-3)


def test_words_of_long_texts_are_cut_at_white_space(monkeypatch):
    texts = ["Ab cD  e", None, "", "x" * 50, "\t".join(prose(k, 9) for k in range(9)), " " * 40]
    whole, counts = language_model.word_hashes(texts)
    monkeypatch.setattr(language_model, "PIECE", 7)
    assert counts.tolist() == [len((t or "").split()) for t in texts]
    again, same = language_model.word_hashes(texts)
    assert (again == whole).all() and (same == counts).all()


def test_symbols_are_a_distribution():
    t = language_model.Table(100, 5, 10, [(b"a", 50), (b"b", 20)], np.zeros(language_model.BANDS, int), np.zeros(language_model.BANDS, int))
    w, kind = language_model.initial(t), language_model.class_of()
    total = 0.0
    for s in range(language_model.SYMBOLS):
        x = np.array([[0], [s]])
        score, _ = language_model.window(w, x, np.array([2]), np.zeros((1, language_model.HIDDEN), np.float32), kind, False)
        first, _ = language_model.window(w, x[:1], np.array([1]), np.zeros((1, language_model.HIDDEN), np.float32), kind, False)
        total += np.exp(score[0] - first[0])
    assert total == pytest.approx(1, abs=1e-3)


def test_vocabulary_grows_with_the_corpus(spark):
    words = [f"w{k}" for k in range(1500)]
    rows = [(k, " ".join(words)) for k in range(60)]
    n = sum(not language_model.held_out(k) for k, _ in rows)
    _, t = language_model.count_words(*language_model.to_blocks(spark.createDataFrame(rows, "doc_id long, text string"), language_model.BLOCK_BYTES))
    assert n >= language_model.least_count(n * 1500) and sorted(w for w, _ in t.top) == sorted(language_model.word_hashes(words)[0].view(np.int64).tolist())
    w, kind = language_model.initial(t), language_model.class_of(t.shape)
    x, h = np.stack([np.zeros(len(kind), int), np.arange(len(kind))]), lambda: np.zeros((len(kind), language_model.HIDDEN), np.float32)
    score, grads = language_model.window(w, x, np.full(len(kind), 2), h(), kind, True)
    first, _ = language_model.window(w, x[:1], np.full(len(kind), 1), h(), kind, False)
    assert np.exp(score - first).sum() == pytest.approx(1, abs=1e-3)
    assert all(g.shape == w[k].shape for k, g in grads.items())
    assert language_model.rounds_for(10**9) > language_model.rounds_for(10**8) > language_model.ROUNDS


def test_gradients():
    rng = np.random.default_rng(0)
    t = language_model.Table(100, 5, 10, [(b"a", 50), (b"b", 20)], np.ones(language_model.BANDS, int), np.ones(language_model.BANDS, int))
    w = {k: v.astype(np.float64) for k, v in language_model.initial(t).items()}
    kind, x, lengths = language_model.class_of(), rng.integers(0, 60, (7, 3)), np.array([7, 5, 2])
    start = lambda: np.zeros((3, language_model.HIDDEN))
    _, grads = language_model.window(w, x, lengths, start(), kind, True)
    for name in ("gate", "new", "state", "out", "in", "in_b"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        old, step, out = w[name][at], 1e-3, []
        for d in (step, -step):
            w[name][at] = old + d
            out.append(language_model.window(w, x, lengths, start(), kind, False)[0].sum())
        w[name][at] = old
        assert -(out[0] - out[1]) / (2 * step) == pytest.approx(grads[name][at], rel=0.02)


def test_pipeline(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert rows.groupby("sequence_id").length.sum().max() <= 2048
    assert set(rows.doc_id) <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "MinHash near-dedup", "best-fit packing"]


def test_pipeline_defined_cases(spark, odd, empty, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing columns, an empty table."""
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    clash = {c: F.lit(3) for c in ("score", "predicted", "document", "kept", "class_id", "n_words", "id", "y", "k1")}
    for name, docs in (("odd", odd.withColumns(clash)), ("none", empty)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        at = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        schema = at.schema
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
            at = stage(spark, at, f"{tmp_path}/{name}")
            assert at.schema.names == schema.names
            at.write.parquet(f"{tmp_path}/{name}/{k}")
            at = spark.read.parquet(f"{tmp_path}/{name}/{k}")
        left = at.collect()
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").toPandas()
        assert Counter(r.doc_id for r in left) == Counter(None if i != i else i for i in rows[rows.piece == 0].doc_id)
        # long prose, one of its copies and repeats, and the document without an id; the rules reject the others
        want = {ODD[7], ODD[8], "no id " + prose(3, 20)} if name == "odd" else set()
        assert Counter(r.text for r in left) == Counter(want)
        assert name == "none" or {r.doc_id for r in left} == {7, 8, None}


def test_scratch_leaves_what_is_kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = set(Path(storage.shared_dir(spark).removeprefix("file://")).iterdir()) if storage.new_dir(spark, "x") else set()
    with pytest.raises(ZeroDivisionError), storage.scratch(spark):
        storage.staged(docs, "lost")
        raise ZeroDivisionError
    with storage.scratch(spark) as keep:
        with storage.scratch(spark) as hand_on:
            storage.staged(docs, "inner")
            handed = hand_on(storage.staged(docs, "handed"))
        assert handed.count() == docs.count()
        kept = keep(storage.staged(minhash.near_duplicates(docs), "kept"))
    assert kept.count() == docs.count()
    left = set(Path(storage.shared_dir(spark).removeprefix("file://")).iterdir()) - before
    assert [x.name.split("-")[0] for x in left] == ["kept"]


def test_no_local_folder_on_a_cluster():
    assert [storage.is_local(x) for x in ("local", "local[8]", "local[*,4]", "local-cluster[3,2,1024]", "spark://a:7077", "yarn")] == [True, True, True, False, False, False]


def test_run_is_the_best_of_all():
    import itertools
    import random

    rng = random.Random(5)
    for _ in range(400):
        x = [rng.choice((-6, -3, -1, -1, 0, 1, 2, 5)) for _ in range(rng.randint(0, 14))]
        best = max((sum(x[i:j]) for i, j in itertools.combinations(range(len(x) + 1), 2)), default=0)
        first, end = html_extract.best_run(x)
        assert sum(x[first:end]) == max(0, best) and (end > first) == (best > 0)


def test_marked_runs_of_pages_are_the_best_of_all():
    """The region of real pages: no other run of tags and words scores more."""
    learned = html_extract.weights()
    for seed in range(3000, 3020):
        blocks = html_extract.blocks_of("".join(h + (t or "") for h, t, _ in labelled_page(seed)), learned)
        runs = []
        for b in blocks:
            score = max(-html_extract.LIMIT, min(html_extract.LIMIT, b.score + sum(learned.get(f, 0.0) for f in html_extract._own_facts(b))))
            runs += [html_extract.TAG_SCORE * b.tags, score * b.words * (1 if score > 0 else html_extract.ISLAND)]
        first, end = html_extract.best_run(runs)
        assert sum(runs[first:end]) >= max(sum(runs[i:j]) for i in range(len(runs)) for j in range(i + 1, len(runs) + 1)) - 1e-9


LONG_PAGES = {
    "nested": lambda n: "<div>word two" * n,
    "open quotes": lambda n: '<a "' * n,
    "odd quotes": lambda n: '<div title="x>a' * n + "'",
    "unclosed": lambda n: "<a " * n,
    "closers of nothing": lambda n: "<div>" * n + "</section>x" * n,
    "inline": lambda n: "<b><div>" + "<i>" * n + "</b>x" * n,
    "names": lambda n: "<a<" * n,
}


@pytest.mark.parametrize("kind", LONG_PAGES)
def test_time_is_linear(kind):
    import time

    learned, took = html_extract.weights(), []
    for n in (8_000, 64_000):
        page = LONG_PAGES[kind](n)
        began = time.process_time()
        html_extract.extract(page, learned)
        took.append(time.process_time() - began)
    # a quadratic scan would take 64 times as long; the floor keeps short times out of it
    assert took[1] < 20 * max(took[0], 0.05)


def test_long_page_and_empty_table(spark):
    page = "<nav><a href=x>Home</a></nav><article>" + "<p>plain words of a story &amp; more</p>" * 250_000 + "</article>"
    text = html_extract.extract(page, html_extract.weights())
    assert len(page) > 9_000_000 and text.split("\n") == ["plain words of a story & more"] * 250_000
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract_pages(empty, "page_id", "url").collect() == []
