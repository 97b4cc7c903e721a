"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a local master gets one of its own and a cluster is refused."""
    shared, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not shared and context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return shared or os.path.join(tempfile.gettempdir(), "liftloom-checkpoints")


FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
JOINS_PARTS = "spark.sql.unionOutputPartitioning"


@contextmanager
def _held(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def freed(spark: SparkSession):
    """Shuffle files of frames that are made and computed within go with the end of their job, not when the driver happens to collect its garbage."""
    return _held(spark, FREES, "true")


def apart(spark: SparkSession):
    """A union computed within keeps the tasks of its parts; else Spark has parts of one partition each computed by a single task, in turn."""
    return _held(spark, JOINS_PARTS, "false")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder; what was shuffled for it is freed."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    with freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def dropped(*frames: DataFrame) -> None:
    """The files of frames given by ``cut`` go; nothing may read these frames, or others made from them, any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        written = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if written.isDefined():
            path = context._jvm.org.apache.hadoop.fs.Path(written.get())
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
