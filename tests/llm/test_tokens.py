import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shotloom.llm import bitfile, bpe, packing, token_count
from shotloom.llm.tokens import Encoder, tokenizer_path

PIECES = [" ", "  ", "\n", "\t", "\x1c", "\x85", " ", "a", "B", "é", "é", "ß", "İ", "Σ", "1", "!", "<|endoftext|>", "'s", "漢", "\x00", "ﬁ", "_", ".", "­"]


def library(name, as_text=False):
    tok = Tokenizer.from_file(tokenizer_path(name))
    tok.no_padding()
    tok.no_truncation()
    tok.encode_special_tokens = as_text
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids, tok


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name):
    enc, (ids, _), rng = Encoder(tokenizer_path(name)), library(name), random.Random(4)
    for _ in range(5000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 10)))
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == ids(text), repr(text)
        assert np.frombuffer(b"".join(map(lambda p: enc.encode_chunk(p.decode()), enc.parts(text))), "<u4").tolist() == ids(text)


def test_bpe_round_trip(odd, empty):
    ids, tok = library("word_bpe_49k.json")
    got = sorted((r.doc_id if r.doc_id is not None else -1, tuple(r.ids), r.decoded) for r in bpe.decode(bpe.encode(odd)).collect())
    want = [(r.doc_id if r.doc_id is not None else -1, tuple(ids(r.text)), tok.decode(ids(r.text), skip_special_tokens=False)) for r in odd.collect()]
    assert got == sorted(want)
    assert bpe.encode(empty).count() == 0
    assert bpe.decode(bpe.encode(empty)).count() == 0


def test_decoding_of_any_ids(spark):
    _, tok = library("word_bpe_49k.json")
    rows = [(1, [5, 5, 900], 7), (2, [], 8), (3, None, 9), (3, [0, 49_000], 9), (None, [900], None)] * 2
    df = spark.createDataFrame(rows, "head long, ids array<int>, id int").repartition(2)
    got = bpe.decode(df)
    assert got.columns == ["head", "ids", "id", "decoded"]
    key = lambda r: (repr(r[0]), repr(r[1]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((*r, tok.decode(r[1] or [], skip_special_tokens=False)) for r in rows), key=key)
    with pytest.raises(Exception, match="out of bounds"):
        bpe.decode(df.withColumn("ids", F.array(F.lit(10_000_000)))).collect()


def test_packing(odd, empty):
    ids, _ = library("byte_bpe_50k.json")
    rows = packing.pack_documents(odd, capacity=64).toPandas()
    docs = {r.doc_id: ids(r.text) + [0] for r in odd.collect()}
    assert rows.groupby("sequence_id").length.sum().max() <= 64
    ordered = rows.sort_values(["sequence_id", "offset"])
    assert ((ordered.groupby("sequence_id").length.cumsum() - ordered.length) == ordered.offset).all()
    for r in rows.itertuples():
        own = docs[None if r.doc_id != r.doc_id else int(r.doc_id)][r.start : r.start + r.length]
        assert len(own) == r.length and zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
    assert rows.length.sum() == sum(len(docs[r.doc_id]) for r in odd.collect())
    assert packing.pack_documents(empty).count() == 0


def test_best_fit_is_tight():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 65, 4000)
    bins = packing.best_fit(sizes, 64)
    assert sorted(i for b in bins for i in b) == list(range(4000))
    assert len(bins) <= np.ceil(sizes.sum() / 64) * 1.02


@pytest.mark.parametrize("bits", [1, 3, 8, 16, 17, 31])
def test_bits(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype("<u4")
    assert (bitfile.unpack_bits(bitfile.pack_bits(ids, bits), bits, 1000) == ids).all()


def test_bit_files(spark, odd, empty, tmp_path):
    ids, _ = library("word_bpe_49k.json")
    files = bitfile.write_tokens(odd, str(tmp_path), files=3)
    rows = bitfile.read_documents(spark, files).toPandas().sort_values("start")
    assert (rows.start.values == np.concatenate([[0], rows.n_tokens.cumsum()[:-1]])).all()
    key = rows.doc_id.fillna(-1)
    assert key.is_monotonic_increasing
    want = sorted((-1 if r.doc_id is None else r.doc_id, zlib.crc32(np.array(ids(r.text) + [1], "<u4").tobytes())) for r in odd.collect())
    assert sorted(zip(key.astype(int), rows.ids_crc32, strict=True)) == want
    reader = bitfile.Reader(files[0][0])
    whole = reader.slice(0, reader.size)
    assert (reader.slice(3, reader.size - 2) == whole[3:-2]).all()
    assert bitfile.read_documents(spark, bitfile.write_tokens(empty)).count() == 0


def test_bit_files_are_bounded(spark, odd, tmp_path):
    """Tasks go on to another file; what is read back is the same."""
    whole, cut = (bitfile.write_tokens(odd, str(tmp_path / str(most)), files=2, file_ids=most, file_docs=3) for most in (1 << 27, 50))
    assert len(whole) >= 4 and max(n for _, n, _ in whole) == 3
    for name, n_docs, n_ids in cut:  # only the last document of a file may pass the bound
        ends = bitfile.Reader(name).ends
        assert len(ends) == n_docs and ends[-1] == n_ids and (n_docs == 1 or ends[-2] < 50)
    rows = [sorted(map(tuple, bitfile.read_documents(spark, x).collect()), key=lambda r: r[1]) for x in (whole, cut, bitfile.write_tokens(odd, files=1))]
    assert rows[0] == rows[1] == rows[2]


def test_separator_scan(spark, tmp_path):
    rng, files, want = np.random.default_rng(0), [], []
    for k in range(3):
        ids = rng.integers(0, 6, 5000).astype("<u2")
        ids[1000:1500] = 1  # a document over many ranges
        (tmp_path / f"{k}.bin").write_bytes(ids.tobytes())
        files.append((str(tmp_path / f"{k}.bin"), 10000))
        runs = "".join("|" if x == 5 else "." for x in ids).split("|")
        want += [(files[-1][0], p, len(r), True) for p, r in enumerate(runs[:-1])] + ([(files[-1][0], len(runs) - 1, len(runs[-1]), False)] if runs[-1] else [])
    df = spark.createDataFrame([*files, (str(tmp_path / "none.bin"), 0)], "file string, bytes long")
    ranges = token_count.scan_ranges(token_count.file_ranges(df, 2, 64), 5, 2)
    got = token_count.count_documents(ranges, group=8).select("file", "position", "n_tokens", "closed").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_token_counts(odd, empty):
    ids, _ = library("byte_bpe_50k.json", as_text=True)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in token_count.document_tokens(odd).collect())
    assert got == sorted((-1 if r.doc_id is None else r.doc_id, len(ids(r.text))) for r in odd.collect())
    assert token_count.document_tokens(empty).count() == 0


