"""Incremental ingest of event files as a stream: an extension, for lakes that grow while they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalize import normalize_events
from ..schemas import RAW


def stream_events(spark: SparkSession, root: str, files_per_batch: int = 50) -> DataFrame:
    """Normalised events of files as they arrive."""
    raw = spark.readStream.schema(RAW["events"]).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).json(f"{root}/events")
    return normalize_events(raw.withColumn("match_id", F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)\.json$", 1).cast("long")))


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and kind, with a watermark for late rows; works on streams and tables."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
