"""Processed tables as zstd Parquet, checked against their schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import DATASET_COLUMNS, TABLES
from .raw import SourceError

DATASET = "shot_dataset"


@dataclass(frozen=True, slots=True)
class TableSummary:
    name: str
    rows: int
    columns: int
    bytes: int


def apply_schema(df: DataFrame, name: str) -> DataFrame:
    """Declared columns first, in order and cast; undeclared ones behind; a missing column is an error."""
    fields = StructType.fromDDL(TABLES[name]).fields
    missing = [f.name for f in fields if f.name not in df.columns]
    if missing:
        raise SourceError(f"{name}: missing columns {missing}")
    known = {f.name for f in fields}
    return df.select(*[F.col(f.name).cast(f.dataType) for f in fields], *[c for c in df.columns if c not in known])


def write_table(df: DataFrame, name: str, root: str) -> TableSummary:
    """Overwrites one table; rows are counted while they are written."""
    if name not in TABLES:
        raise SourceError(f"unknown table {name}; tables are {sorted(TABLES)}")
    return _write(df, name, root)


def _write(df: DataFrame, name: str, root: str) -> TableSummary:
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{name}")
    target = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    files = target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    return TableSummary(name, seen.get["rows"], len(df.columns), files.getContentSummary(target).getLength())


def write_shot_dataset(df: DataFrame, root: str) -> TableSummary:
    """Overwrites the feature table, which must have exactly the columns of ``schemas.DATASET_COLUMNS``."""
    if tuple(df.columns) != DATASET_COLUMNS:
        raise SourceError(f"{DATASET}: the columns must be {', '.join(DATASET_COLUMNS)}")
    return _write(df, DATASET, root)


def read_shot_dataset(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{root}/{DATASET}")
    except AnalysisException as e:
        raise SourceError(f"{DATASET} isn't under {root}; build the features first") from e


def read_table(spark: SparkSession, name: str, root: str) -> DataFrame:
    if name not in TABLES:
        raise SourceError(f"unknown table {name}; tables are {sorted(TABLES)}")
    try:
        return spark.read.parquet(f"{root}/{name}")
    except AnalysisException as e:
        raise SourceError(f"{name} isn't under {root}; build the tables first") from e


def register_views(spark: SparkSession, root: str) -> None:
    """A view per table; fails before registering any if one is missing."""
    for name, df in {name: read_table(spark, name, root) for name in TABLES}.items():
        df.createOrReplaceTempView(name)
