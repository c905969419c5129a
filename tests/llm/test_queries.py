"""Each registered query on the smallest tables, against a plain computation of what it must return."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from shotloom.llm import queries
from shotloom.llm.tokens import tokenizer_path

ENDS = "[^\x20\x09-\x0d]+"


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def run(spark, sf, name, types):
    """Rows of a query whose first columns are these."""
    df = queries.queries()[name](spark, sf)
    assert df.dtypes[: len(types.split(", "))] == [tuple(x.split()) for x in types.split(", ")]
    return df.collect()


def ids_of(name, texts):
    tok = Tokenizer.from_file(tokenizer_path(name))
    tok.no_padding()
    tok.no_truncation()
    return {k: tok.encode(t, add_special_tokens=False).ids for k, t in texts.items()}, tok


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark, sf, texts):
    ids, _ = ids_of("byte_bpe_50k.json", texts)
    rows = run(spark, sf, "op1_best_fit_packing", "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for doc, found in pieces.items():
        whole, at = [*ids[doc], 0], 0
        for k, r in enumerate(sorted(found, key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, crc(whole[at : at + r.length]))
            at += r.length
            assert r.length == 2048 or (k == 0 if len(found) > 1 else True)
        assert at == len(whole) and (len(found) == 1) == (len(whole) <= 2048)
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    least = math.ceil(sum(len(x) + 1 for x in ids.values()) / 2048)
    assert least <= len(places) <= least * 1.1 + 2


def test_encode_decode(spark, sf, texts):
    ids, tok = ids_of("word_bpe_49k.json", texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((k, len(x), sha(" ".join(map(str, x))), sha(tok.decode(x, skip_special_tokens=False))) for k, x in ids.items())
    assert sorted(map(tuple, run(spark, sf, "op2_bpe_encode_decode", "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"))) == want


def test_language_model(spark, sf, texts):
    rows = run(spark, sf, "op3_language_model", "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {k: [*re.findall(ENDS, t.translate(lower)), None] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    counts = Counter(w for k, ws in words.items() if not held[k] for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for r in rows:
        ws = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        assert r.score < 0 and math.isfinite(r.score)


def test_rules(spark, sf, texts):
    rows = run(spark, sf, "op5_quality_rules", "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean")
    assert len(rows) == len(texts)
    for r in rows:
        words = re.findall(ENDS, texts[r.doc_id])
        lines = [x for x in texts[r.doc_id].split("\n") if re.search(ENDS, x)]
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        repeated = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
        assert tuple(r)[1:7] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", texts[r.doc_id])), len(lines) - len(set(lines)), len(repeated), failed)
        assert not (failed and r.kept)


def test_near_duplicates(spark, sf, texts):
    rows = {r.doc_id: r for r in queries.op6_minhash_near_dedup(spark, sf).collect()}
    assert set(rows) == set(texts)
    sets = {}
    for k, t in texts.items():
        words = re.findall(r"\S+", t)
        sets[k] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)}
    same = [(a, b) for a in texts for b in texts if a < b and texts[a] and texts[a] == texts[b]]
    assert all(rows[a].class_id == rows[b].class_id for a, b in same)
    for k, r in rows.items():  # nothing is in a class with nothing like it
        if r.class_id != k:
            assert max(len(sets[k] & s) / len(sets[k] | s) for j, s in sets.items() if j != k and rows[j].class_id == r.class_id) > 0.6


def test_bit_packed_tokens(spark, sf, texts):
    ids, _ = ids_of("word_bpe_49k.json", texts)
    want, start = [], 0
    for k in sorted(ids):
        whole = [*ids[k], 1]
        want.append((k, start, len(whole), crc(whole)))
        start += len(whole)
    assert sorted(map(tuple, run(spark, sf, "op7_bit_packed_tokens", "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))) == want


def test_classifier(spark, sf, texts):
    rows = run(spark, sf, "op8_quality_classifier", "doc_id bigint, held_out boolean, score double, predicted int")
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_embeddings(spark, sf):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    keys = sorted(vectors)
    m = np.stack([vectors[k] for k in keys])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    linked = m @ m.T >= 0.95
    np.fill_diagonal(linked, False)
    component = list(range(len(keys)))
    for _ in keys:
        component = [min([component[i], *(component[j] for j in np.flatnonzero(linked[i]))]) for i in range(len(keys))]
    want = [(k, int(linked[i].sum()), keys[component[i]], keys[component[i]] == k) for i, k in enumerate(keys)]
    assert sorted(map(tuple, run(spark, sf, "op9_embedding_near_dedup", "vec_id bigint, n_links bigint, component_id bigint, kept boolean"))) == want


def test_pages(spark, sf):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = run(spark, sf, "op4_html_extraction", "page_id bigint, url string, text string, n_chars bigint")
    assert {r.page_id: r.url for r in rows} == pages and len(rows) == len(pages)
    for r in rows:
        assert r.n_chars == len(r.text) and not re.search(r"^\s|\s$|\n\n|  |<(p|div|script|style)\b", r.text)


def test_token_counts(spark, sf, texts):
    rows = queries.op10_token_counts(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    ids, _ = ids_of("byte_bpe_50k.json", texts)
    assert {k: len(x) for k, x in ids.items()} == {r.doc_id: r.n_tokens for r in rows}
