"""Documents dealt into blocks of compressed text, for operators that look every word up in a table of the whole corpus.

A block is a part of the corpus that fits one task (``BLOCK_BYTES`` of text, or one longer document). Its distinct words
are few against its words, so the pairs (block, word) are what meets the word table, not the words of the texts: a
frequent word is in as many pairs as there are blocks, never in as many as it has occurrences. The table's answers come
back to the block and are put in place there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text of a block, and of a compressed row, before compression.
BLOCK_BYTES = 12 << 20
CHUNK_BYTES = 2 << 20
UNKNOWN = 1 << 60
SCHEMA = "block int, texts binary"
_DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def scan_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of a plan's size; a table's files as they are stored."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def to_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """Rows of compressed documents, repartitioned by block, and the number of blocks.

    The block is a hash of the row, so that copies and sources spread evenly.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = scan_bytes(docs)
    # stored text is some 0.6 of its size; a plan without statistics is taken to be absurdly large
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # with fewer, Spark would deal the blocks out again
    n = max(n, int(size / 0.6 / block_bytes) + 1) if size < UNKNOWN else n
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size: dict[int, int] = {}

        def out(block: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_squeeze(held.pop(block))])], names=["block", "texts"])

        for batch in batches:
            for doc_id, text, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(block, []).append((doc_id, text))
                size[block] = size.get(block, 0) + len(text or "") + 16
                if size[block] > CHUNK_BYTES:
                    size[block] = 0
                    yield out(block)
        for block in list(held):
            yield out(block)

    return rows.mapInArrow(run, SCHEMA).repartition(n, "block"), n


def _squeeze(docs: list[tuple[int | None, str | None]]) -> bytes:
    table = pa.Table.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.string())], schema=_DOCS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _DOCS) as out:
        out.write_table(table)
    return zstandard.compress(sink.getvalue().to_pybytes(), 3)


def unsqueeze(texts: bytes) -> Iterator[tuple[int | None, str | None]]:
    """(doc_id, text) of a compressed row."""
    table = pa.ipc.open_stream(zstandard.decompress(texts)).read_all()
    yield from zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True)
