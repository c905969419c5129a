"""Token counts of flat, unindexed token files by a separator scan.

A flat file is a plain run of little-endian unsigned integers (16 bits for vocabularies of up to 65,536 ids, else 32), in
which an end-of-document id closes every document. Tasks read byte ranges and search them for that id by one vectorised
comparison; documents that cross ranges are stitched by a prefix scan over the ranges: the largest separator position
and the number of separators before each. The scan is over one row per range, in two levels, so no task holds a file.

Defined cases: ids behind the last separator of a file are a last document with ``closed`` false; two separators in a row
are an empty document (count 0); an empty file gives no rows. When writing, a null text is an empty document, a null
``doc_id`` stays null, repeated rows are written once each, and other columns are ignored.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import new_dir, open_fs, staged, write_whole
from .tokens import encoded, encoder, release, tokenizer_path

RANGE_BYTES = 8 << 20


def _dtype(width: int) -> np.dtype:
    return np.dtype({2: "<u2", 4: "<u4"}[width])


def write_flat(docs: DataFrame, target: str | None = None, tokenizer: str | None = None, end_id: int | None = None) -> tuple[DataFrame, int, int]:
    """A flat file per scan task; the rows (file, position of the document in it, doc_id, bytes), the end id and the width.

    Texts are ordinary text throughout: the string of a special token never becomes a separator.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    target, path = target or new_dir(spark, "flat"), tokenizer or tokenizer_path("byte_bpe_50k.json")
    size = Tokenizer.from_file(path).get_vocab_size()
    end = size - 1 if end_id is None else end_id
    width = 2 if max(size, end + 1) <= 1 << 16 else 4
    kind = _dtype(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release()
        enc, uri = encoder(path, as_text=True), posixpath.join(target, f"flat-{TaskContext.get().partitionId():06d}.bin")
        last, doc_ids, ends = np.array([end], kind).tobytes(), [], []

        def parts():
            for batch in batches:
                for doc_id, ids in encoded(enc, batch):
                    data = ids.astype(kind).tobytes() + last
                    doc_ids.append(doc_id)
                    ends.append(len(data))
                    yield data

        stream = parts()
        first = next(stream, None)
        if first is None:
            return
        write_whole(uri, (x for some in ([first], stream) for x in some))
        n = len(doc_ids)
        yield pa.RecordBatch.from_arrays([pa.array([uri] * n), pa.array(np.arange(n)), pa.array(doc_ids, pa.int64()), pa.array(ends, pa.int64())], names=["file", "position", "doc_id", "bytes"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "file string, position long, doc_id long, bytes long")
    return staged(rows, "flat-rows"), end, width


def file_ranges(files: DataFrame, width: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """files (file, bytes) to rows (file, k, at, bytes) of at most ``range_bytes`` each."""
    step = range_bytes - range_bytes % width
    cut = files.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / step))).alias("k"))
    return cut.select("file", "k", (F.col("k") * step).alias("at"), F.least(F.lit(step), F.col("bytes") - F.col("k") * step).cast("long").alias("bytes"))


def scan_ranges(ranges: DataFrame, end_id: int, width: int) -> DataFrame:
    """Per range: its first id's place in the file, the number of its ids, and the places of its separators."""
    kind = _dtype(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, k, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files, path = open_fs(file)
                with files.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(n, at), kind)
                found = np.flatnonzero(ids == end_id) + at // width
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k]), pa.array([at // width + len(ids)]), pa.array([len(found)]), pa.array([int(found[-1]) if len(found) else None], pa.int64()), pa.array([found], pa.list_(pa.int64()))], names=["file", "k", "stop", "n", "last", "found"])

    return ranges.mapInArrow(run, "file string, k long, stop long, n long, last long, found array<long>")


def count_documents(scanned: DataFrame, group: int = 1024) -> DataFrame:
    """(file, position, n_tokens, closed) of each document, from its ranges' separators.

    The prefix scan goes over groups of ``group`` ranges of a file and then within each, so a window holds at most
    ``group`` rows, or one row per group.
    """
    rows = scanned.withColumn("g", F.floor(F.col("k") / group))
    ends = rows.groupBy("file", "g").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max("stop").alias("stop"))
    before = Window.partitionBy("file").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file", "g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("last0"))
    inside = Window.partitionBy("file", "g").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(ends, ["file", "g"])
    rows = rows.withColumn("n1", F.col("n0") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    rows = rows.withColumn("last1", F.coalesce(F.max("last").over(inside), F.col("last0")))
    ahead = F.concat(F.array("last1"), F.slice("found", 1, F.greatest(F.size("found") - 1, F.lit(0))))
    closed = rows.where("n > 0").select("file", "n1", F.posexplode(F.zip_with("found", ahead, lambda x, y: x - y - 1)).alias("j", "n_tokens"))
    closed = closed.select("file", (F.col("n1") + F.col("j")).alias("position"), "n_tokens", F.lit(True).alias("closed"))
    whole = scanned.groupBy("file").agg(F.max("stop").alias("stop"), F.max("last").alias("last"), F.sum("n").alias("position"))
    rest = (F.col("stop") - 1 - F.coalesce("last", F.lit(-1))).alias("n_tokens")
    return closed.unionByName(whole.select("file", "position", rest, F.lit(False).alias("closed")).where("n_tokens > 0"))


def count_files(spark: SparkSession, files: DataFrame, end_id: int, width: int = 2, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Token counts of all documents in flat files; files: (file, bytes)."""
    ranges = file_ranges(files, width, range_bytes)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return count_documents(staged(scan_ranges(ranges.repartition(n, "file", "k"), end_id, width), "ranges"))


def document_tokens(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Encode documents to flat files, count their tokens from those files alone, and name the documents again by place."""
    rows, end, width = write_flat(docs, tokenizer=tokenizer)
    counted = count_files(docs.sparkSession, rows.groupBy("file").agg(F.sum("bytes").alias("bytes")), end, width)
    return rows.select("file", "position", "doc_id").join(counted, ["file", "position"])
