"""Durable intermediate tables and files in the folder that all executors share."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a new local one if the session's executors are threads
    of this machine, as in tests; on a cluster that is an error, as executors elsewhere wouldn't see its files."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not is_local(sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(sc, "_shotloom_dir", None)
        if found is None:
            found = sc._shotloom_dir = "file://" + tempfile.mkdtemp(prefix="shotloom-")
    return found.rstrip("/")


def is_local(master: str) -> bool:
    """Whether a master URL means threads of the driver's own process."""
    return re.fullmatch(r"local(\[.*\])?", master) is not None


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes, at its end, the intermediate tables and files made inside it, but for the staged tables given to the
    function that it yields: results of operators are lazy and read their intermediate tables when they are used.

        with scratch(spark) as keep:
            rows = keep(staged(near_duplicates(docs), "classes"))

    Tables kept in an inner scratch belong to the outer one, if there is one.
    """
    stack = spark.sparkContext.__dict__.setdefault("_shotloom_scratch", [])
    made: dict[str, None] = {}
    stack.append(made)
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._staged_at)
        return df

    try:
        yield keep
    finally:
        stack.pop()
        for path in made.keys() - set(kept):
            drop_dir(spark, path)
        if stack:
            stack[-1].update(dict.fromkeys(kept))


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = posixpath.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    if stack := getattr(spark.sparkContext, "_shotloom_scratch", None):
        stack[-1][path] = None
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back, so that its lineage ends there."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def free(*frames: DataFrame) -> None:
    """Delete staged tables that nothing will read any more; other frames are left alone."""
    for df in frames:
        if path := getattr(df, "_staged_at", None):
            drop_dir(df.sparkSession, path)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder through the Hadoop file system that holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def open_fs(uri: str):
    """(file system, path) of a URI, for tasks that read or write files of their own format."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def write_whole(uri: str, parts) -> None:
    """Write a file under a temporary name, then move it into place: a task that is run again leaves one whole file."""
    files, path = open_fs(uri)
    files.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part) as out:
        for x in parts:
            out.write(x)
    files.move(part, path)
