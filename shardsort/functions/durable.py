"""Lineage cuts that survive the loss of executors, in the folder that executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders written by this process; they are deleted when it ends.
_own: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir (or set on the context); only a local master may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="shardsort-")
    _own.append((spark, folder))
    context.setCheckpointDir(folder)
    return folder


def own_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, deleted when the process ends."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    _own.append((spark, path))
    return path


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder (below it, in a folder that is deleted when the process ends)."""
    spark = df.sparkSession
    jvm_context = spark.sparkContext._jsc.sc()
    if not jvm_context.getCheckpointDir().isDefined():
        path = own_path(spark, "checkpoint")
        if not jvm_context.getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(path)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same rows from a table written into the shared folder: column by column, read as needed."""
    path = own_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in reversed(_own):
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; the folder's owner cleans up
            return
