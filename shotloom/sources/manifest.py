"""Incremental ingest of raw files: a manifest of what has been read, and records that count only once it says so.

A run lists the files, drops those whose length and time the manifest knows, reads the others once, and drops those whose
content it knows. What is left becomes one batch of records (file, position in the file's array, record); the manifest's
rows of that batch are written afterwards, so a run that fails before has changed nothing that a reader sees. Of a file
that changed, the last batch counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import RAW
from .raw import SourceError

_MANIFEST = "file string, length long, modified timestamp, sha256 string, records long, has_records boolean, batch long"


@dataclass(frozen=True, slots=True)
class IngestSummary:
    """Files found, read (their content was looked at) and taken (as new or changed records), and the records of these."""

    found: int
    read: int
    taken: int
    records: int


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def manifest(spark: SparkSession, lake: str, entity: str) -> DataFrame:
    """A row per file: what is known of it last, and ``holds``, the batch with its records."""
    path = f"{lake}/_manifest/{entity}"
    if not _exists(spark, path):
        return spark.createDataFrame([], f"{_MANIFEST}, holds long")
    rows = spark.read.schema(_MANIFEST).parquet(path)
    held = F.max(F.when(F.col("has_records"), F.col("batch"))).over(Window.partitionBy("file"))
    latest = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("batch")))
    return rows.withColumns({"holds": held, "_k": latest}).where("_k = 1").drop("_k")


def ingest(spark: SparkSession, pattern: str, lake: str, entity: str) -> IngestSummary:
    """Takes the records of new and changed files of an entity (``schemas.RAW``); a file that isn't a JSON array is an error."""
    try:
        listed = spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"))
    except AnalysisException as e:
        raise SourceError(f"{entity}: nothing at {pattern}; download or place the raw files first") from e
    known = manifest(spark, lake, entity)
    fresh = listed.join(known.select("file", "length", "modified"), ["file", "length", "modified"], "left_anti").persist()
    try:
        found, unread = listed.count(), [r["file"] for r in fresh.select("file").collect()]
        if not unread:
            return IngestSummary(found, 0, 0, 0)
        batch = (known.agg(F.max("batch")).first()[0] or 0) + 1
        # only the paths that the anti-join left are opened
        texts = spark.read.text(unread, wholetext=True).select(F.regexp_replace("value", "^[\\s\\ufeff]+", "").alias("text"), F.col("_metadata.file_path").alias("_path"))
        whole = F.when(F.col("text").startswith("["), F.col("text")).otherwise(F.raise_error(F.concat(F.col("_path"), F.lit(" isn't a JSON array"))))
        same = lambda c: F.regexp_replace(c, "^file:/+", "/")
        seen = texts.select(same(F.col("_path")).alias("_at"), F.sha2("text", 256).alias("sha256"), whole.alias("text"))
        seen = seen.join(fresh.withColumn("_at", same(F.col("file"))), "_at").drop("_at")
        seen = seen.join(known.select("file", F.col("sha256").alias("old"), "holds"), "file", "left")
        changed = F.col("old").isNull() | (F.col("old") != F.col("sha256"))
        rows = seen.where(changed).select("file", F.posexplode(F.from_json("text", f"array<struct<{_struct(entity)}>>", {"mode": "FAILFAST"})).alias("position", "record"))
        # records of this number are those of a run that failed before its entries
        rows.write.mode("overwrite").parquet(f"{lake}/_records/{entity}/batch={batch}")
        written = spark.read.parquet(f"{lake}/_records/{entity}/batch={batch}").groupBy("file").agg(F.count("*").alias("records"))
        entries = seen.join(written, "file", "left").select("file", "length", "modified", "sha256", F.coalesce("records", F.lit(0)).cast("long").alias("records"), changed.alias("has_records"), F.lit(batch).cast("long").alias("batch"))
        entries.coalesce(1).write.mode("append").parquet(f"{lake}/_manifest/{entity}")
        mine = spark.read.schema(_MANIFEST).parquet(f"{lake}/_manifest/{entity}").where((F.col("batch") == batch) & F.col("has_records"))
        taken, records = mine.agg(F.count("*"), F.coalesce(F.sum("records"), F.lit(0))).first()
        return IngestSummary(found, len(unread), taken, records)
    finally:
        fresh.unpersist()


def _struct(entity: str) -> str:
    if entity not in RAW:
        raise SourceError(f"unknown entity {entity}; entities are {sorted(RAW)}")
    schema = RAW[entity]
    return schema if isinstance(schema, str) else schema.simpleString()[len("struct<") : -1]


def read_ingested(spark: SparkSession, lake: str, entity: str) -> DataFrame:
    """The records of each file's last batch, with ``file``, ``position`` and, where the file's name is a number, ``match_id``."""
    path = f"{lake}/_records/{entity}"
    if not _exists(spark, path):
        raise SourceError(f"{entity}: nothing has been ingested under {lake}")
    current = manifest(spark, lake, entity).select("file", F.col("holds").alias("batch"))
    rows = spark.read.parquet(path).withColumn("batch", F.col("batch").cast("long")).join(current, ["file", "batch"], "left_semi")
    number = F.nullif(F.regexp_extract("file", r"(\d+)\.json$", 1), F.lit("")).cast("long")
    columns = rows.schema["record"].dataType.names
    extra = [] if "match_id" in columns else [number.alias("match_id")]
    return rows.select("file", "position", *[F.col(f"record.{c}").alias(c) for c in columns], *extra)


def first_matches(matches: DataFrame, limit: int) -> DataFrame:
    """The first match ids of each file of ingested matches, in the file's order; at least one."""
    if limit < 1:
        raise ValueError("limit_matches must be at least 1")
    place = F.row_number().over(Window.partitionBy("file").orderBy("position"))
    return matches.withColumn("_k", place).where(F.col("_k") <= limit).select("file", "position", "match_id")


def competition_season(text: str) -> tuple[int, int]:
    """(competition_id, season_id) of an argument such as 43/3."""
    left, slash, right = text.partition("/")
    if not slash:
        raise ValueError(f"expected COMPETITION_ID/SEASON_ID, got {text!r}")
    try:
        return int(left), int(right)
    except ValueError:
        raise ValueError(f"competition and season ids must be whole numbers, got {text!r}") from None
