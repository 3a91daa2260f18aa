"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task sorts or groups, about.
ROWS = 1 << 19
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own, and only on a machine that runs all tasks itself."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


def _path(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files: they go with the write, not when the driver next collects garbage,
    which with much memory is after the whole job."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def kept(df: DataFrame, name: str = "kept", slim: bool = False) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage is cut and any executor can reread it.
    The files go when the application ends, or by drop().

    slim: rows of a few numbers, made by a short last stage; they are written by no more than twice the tasks that run
    at once, or a sixteenth of the shuffle's partitions, so that rounds over small tables don't leave thousands of tiny files.
    """
    spark = df.sparkSession
    if slim:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(at)
    path, system = _path(spark, at)
    system.deleteOnExit(path)
    back = spark.read.schema(df.schema).parquet(at)
    back._kept_at = at
    return back


def apart(df: DataFrame) -> DataFrame:
    """df for a join by shuffles: rows by node, whose files look small enough to be broadcast, would pass through the driver each round."""
    return df.hint("merge")


def dealt(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """df with rows of equal keys in one task, and as many tasks as so many rows ask for. Left alone, few tasks share what is small
    while compressed, and each holds all its rows to sort or group them. Without rows df is as it was."""
    return df if rows is None else df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / ROWS)), *keys)


def drop(df: DataFrame) -> None:
    """Remove the files of what kept() returned; nothing may read them any more."""
    at = getattr(df, "_kept_at", None)
    if at:
        path, system = _path(df.sparkSession, at)
        system.delete(path, True)
        df._kept_at = None
