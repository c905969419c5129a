"""Token ids in files of fixed-width bit-packed blocks.

A file holds: the 8-byte magic, blocks of ``BLOCK`` ids packed in ``bits`` bits each (little-endian 64-bit words), the
int64 ids of its documents, the int64 end of each document (its ids and those before it in the file), the int64 offset
of each block, and a footer of six int64: bits, block size, number of ids, documents, blocks, and the magic as a number.
Any id is found by its block's offset and its place; a block is unpacked by vectorised shifts.

A file ends after the document that takes it to ``FILE_IDS`` ids or ``FILE_DOCS`` documents, whichever comes first, so the
number of files grows with the corpus and not their size. Files hold ascending ``doc_id`` ranges (nulls first; rows of equal id by a hash of their text), so that file k's ids
come before file k+1's. A null text is a document of the end id only; repeated rows are written once each; an empty table
gives no files.
"""

from __future__ import annotations

import posixpath
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import UNKNOWN, scan_bytes
from .storage import new_dir, open_fs, write_whole
from .tokens import encoded, encoder, release, tokenizer_path

MAGIC = b"SLBITS01"
BLOCK = 65_536
END_ID = 1
#: Ids and documents after which a task begins another file, so that a file and its index are bounded.
FILE_IDS, FILE_DOCS = 1 << 27, 1 << 20
#: Stored text that a task takes, as far as the optimiser knows the size of the table.
TASK_BYTES = 256 << 20
#: Stored for a null doc_id.
NO_ID = -(2**63)


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id of a vocabulary."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, low bits first; 64 ids fill ``bits`` 64-bit words."""
    rows = -(-len(ids) // 64)
    full = np.zeros(rows * 64, np.uint64)
    full[: len(ids)] = ids
    full, out = full.reshape(rows, 64), np.zeros((rows, bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= full[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= full[:, j] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed data."""
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    out, mask = np.empty((len(words), 64), np.uint64), np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        got = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            got = got | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = got & mask
    return out.reshape(-1)[:n].astype("<u4")


class Writer:
    """The parts of one file, block by block."""

    def __init__(self, bits: int, block: int = BLOCK):
        self.bits, self.block, self.wait, self.size = bits, block, b"", 0
        self.doc_ids: list[int] = []
        self.ends: list[int] = []
        self.offsets: list[int] = []
        self.at = len(MAGIC)

    def add(self, docs) -> Iterator[bytes]:
        """docs: (doc_id, little-endian 32-bit ids) of documents in order."""
        yield MAGIC
        parts: list[bytes] = []
        held = 0
        for doc_id, data in docs:
            self.size += len(data) // 4
            self.doc_ids.append(NO_ID if doc_id is None else doc_id)
            self.ends.append(self.size)
            parts.append(data)
            held += len(data)
            if held >= 4 * self.block:
                yield from self._blocks(b"".join(parts), False)
                parts, held = [self.wait], len(self.wait)
        yield from self._blocks(b"".join(parts), True)
        for x in (self.doc_ids, self.ends, self.offsets, [self.bits, self.block, self.size, len(self.ends), len(self.offsets), int.from_bytes(MAGIC, "little")]):
            yield np.array(x, "<i8").tobytes()

    def _blocks(self, data: bytes, last: bool) -> Iterator[bytes]:
        ids, k = np.frombuffer(data, "<u4"), 0
        while len(ids) - k >= self.block or last and k < len(ids):
            packed = pack_bits(ids[k : k + self.block], self.bits)
            self.offsets.append(self.at)
            self.at += len(packed)
            k += self.block
            yield packed
        self.wait = ids[k:].tobytes()


class Reader:
    """Random and sequential access to one file."""

    def __init__(self, uri: str):
        files, path = open_fs(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        self.bits, self.block, self.size, docs, blocks, magic = np.frombuffer(self.file.read_at(48, size - 48), "<i8").tolist()
        if magic != int.from_bytes(MAGIC, "little"):
            raise ValueError(f"{uri} isn't a token file")
        index = np.frombuffer(self.file.read_at(8 * (2 * docs + blocks), size - 48 - 8 * (2 * docs + blocks)), "<i8")
        self.doc_ids, self.ends, self.offsets = index[:docs], index[docs : 2 * docs], index[2 * docs :]

    def block_ids(self, k: int) -> np.ndarray:
        n = min(self.block, self.size - k * self.block)
        return unpack_bits(self.file.read_at(-(-n // 64) * 8 * self.bits, int(self.offsets[k])), self.bits, n)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to stop, reading only the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, "<u4")
        first = start // self.block
        got = np.concatenate([self.block_ids(k) for k in range(first, (stop - 1) // self.block + 1)])
        return got[start - first * self.block : stop - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, start in the file, number of ids, their crc32), reading each block once."""
        k, have, crc, start = -1, np.zeros(0, "<u4"), 0, 0
        for doc_id, end in zip(self.doc_ids.tolist(), self.ends.tolist(), strict=True):
            at, crc = start, 0
            while at < end:
                if at // self.block != k:
                    k = at // self.block
                    have = self.block_ids(k)
                stop = min(end, (k + 1) * self.block)
                crc = zlib.crc32(have[at - k * self.block : stop - k * self.block].tobytes(), crc)
                at = stop
            yield (None if doc_id == NO_ID else doc_id), start, end - start, crc
            start = end


_FILES = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def _until_full(writer: Writer, first, rest: Iterator, ids: int, docs: int) -> Iterator:
    """The first document, then others until the writer holds as many ids or documents as a file may."""
    yield first
    while writer.size < ids and len(writer.ends) < docs and (x := next(rest, None)) is not None:
        yield x


def write_tokens(docs: DataFrame, target: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, files: int | None = None, file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS) -> list[tuple[str, int, int]]:
    """Encode documents and write them in ascending doc_id order; (file, documents, ids) of each file in order.

    ``files`` is the number of id ranges, each written by one task as one file, or several if it is longer than a file may
    be. One small row per file reaches the driver. Documents are dealt by ranges of their ids before they are encoded, so
    each text is encoded once.
    """
    spark = docs.sparkSession
    target, path = target or new_dir(spark, "tokens"), tokenizer or tokenizer_path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()
    size = scan_bytes(docs)
    n = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size / TASK_BYTES) if size < UNKNOWN else 0)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release()
        enc, shard = encoder(path), TaskContext.get().partitionId()
        bits, number = bits_for(max(enc.size, end_id + 1)), 0
        ids = ((d, x.tobytes() + end) for b in batches for d, x in encoded(enc, b))
        while (first := next(ids, None)) is not None:
            writer, uri = Writer(bits), posixpath.join(target, f"tokens-{shard:06d}-{number:06d}.bits")
            write_whole(uri, writer.add(_until_full(writer, first, ids, file_ids, file_docs)))
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [uri], "n_docs": [len(writer.ends)], "n_ids": [writer.size]}, schema=_FILES)
            number += 1

    ordered = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return [(r["file"], r["n_docs"], r["n_ids"]) for r in sorted(ordered.mapInArrow(run, "shard int, file string, n_docs long, n_ids long").collect())]


def read_documents(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    base, listed = 0, []
    for name, _, n in files:
        listed.append((name, base))
        base += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(zip(*Reader(name).documents(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(np.array(found[1], np.int64) + before), pa.array(found[2], pa.int64()), pa.array(found[3], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not listed:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(listed, "file string, before long").repartition(len(listed)).mapInArrow(run, schema)
