"""BPE encoding and decoding of whole corpora through a table of distinct words.

Texts are split into words; each distinct word of the corpus is encoded once, in the table; the ids come back to the
blocks of documents that hold the word (see ``blocks``) and are put in place by position. Decoding joins ids to the
vocabulary's pieces: a table bounded by the vocabulary, sent to the tasks, in which an id is a row number.

Defined cases: a null or empty text has no ids and decodes to the empty string; repeated rows give a row each; a null
``doc_id`` stays null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from .blocks import BLOCK_BYTES, to_blocks, unsqueeze
from .tokens import encoder, tokenizer_path

ENCODED = "doc_id long, ids array<int>"


def _pack(words: list[bytes]) -> bytes:
    return zstandard.compress(np.array([len(words), *map(len, words)], "<u4").tobytes() + b"".join(words), 3)


def _unpack(data: bytes) -> list[bytes]:
    data = zstandard.decompress(data)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = (np.cumsum(np.frombuffer(data, "<u4", n + 1)[1:].astype(np.int64)) + 4 * (n + 1)).tolist()
    return [data[a:b] for a, b in zip([4 * (n + 1), *ends], ends, strict=False)]


def _parts_of(words, parts: int) -> dict[int, list[bytes]]:
    """Words in order, by the part of the word table that they belong to."""
    out: dict[int, list[bytes]] = {}
    for w in words:
        out.setdefault(zlib.crc32(w) % parts, []).append(w)
    return {k: sorted(v) for k, v in out.items()}


def _words_of(rows, enc) -> set[bytes]:
    found: set[bytes] = set()
    for row in rows:
        for _, text in unsqueeze(row):
            found.update(enc.parts(text))
    return found


def encode(docs: DataFrame, tokenizer: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and the ids of each whole text.

    The word table is partitioned by a hash of the word. A block sends each partition the words that it holds, in order,
    as one row; the partition encodes every word that it hasn't met and answers with ids in the same order, which the
    block puts in the places of its words.
    """
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    blocks, n = to_blocks(docs, block_bytes)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, found = encoder(path), {}
        for batch in batches:
            for block, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.setdefault(block, set()).update(_words_of([texts], enc))
        for block, words in found.items():
            for part, own in _parts_of(words, n).items():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([_pack(own)], pa.binary())], names=["part", "block", "words"])

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, known = encoder(path), {}
        for batch in batches:
            for part, block, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = []
                for w in _unpack(words):
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = _narrow(enc.encode_chunk(w.decode()))
                    out.append(ids)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([_pack(out)], pa.binary())], names=["block", "part", "ids"])

    asked = blocks.mapInArrow(ask, "part int, block int, words binary").repartition(n, "part")
    answers = asked.mapInArrow(table, "block int, part int, ids binary").repartition(n, "block")

    def place(texts: pa.Table, answers: pa.Table) -> pa.Table:
        enc, known = encoder(path), {}
        enc.forget()
        rows = texts.column("texts").to_pylist()
        asked = _parts_of(_words_of(rows, enc), n)
        for part, ids in zip(answers.column("part").to_pylist(), answers.column("ids").to_pylist(), strict=True):
            known.update(zip(asked.pop(part), _unpack(ids), strict=True))
        del answers
        doc_ids, datas = [], []
        for row in rows:
            for doc_id, text in unsqueeze(row):
                doc_ids.append(doc_id)
                datas.append(b"".join(map(known.__getitem__, enc.parts(text))))
        ends = np.cumsum([0] + [len(x) // 3 for x in datas]).astype(np.int32)
        wide = np.zeros((int(ends[-1]), 4), np.uint8)
        wide[:, :3] = np.frombuffer(b"".join(datas), np.uint8).reshape(-1, 3)
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(wide.reshape(-1).view("<i4")))})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(place, ENCODED)


def _narrow(ids: bytes) -> bytes:
    """Ids in 3 bytes each, which any vocabulary of up to 16 million fits."""
    return np.frombuffer(ids, np.uint8).reshape(-1, 4)[:, :3].tobytes()


def pieces(tokenizer: str) -> list[str]:
    """The vocabulary's pieces in the order of their ids."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer)
    return [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size())]


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Adds ``decoded``: each row's pieces joined by one space, as files without a decoder of their own decode.

    Special tokens stay. Ids outside the vocabulary are an error. Null ids give the empty string.
    """
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    table = encoded.sparkSession.sparkContext.broadcast(pieces(path))
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.array(table.value, pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                ids = pc.fill_null(some.column(names.index("ids")), pa.scalar([], pa.list_(pa.int32())))
                flat = own.take(ids.flatten())
                counts = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([*some.columns, pc.binary_join(lists, " ")], names=[*names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, decoded string")
