"""Helpers that the operators of this package share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_RE = r"[^\x20\x09-\x0D]+"
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
MASK64 = (1 << 64) - 1


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a table by path through Spark, so any file system that Spark knows works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only on one machine (a local master, as in tests) that has no such setting is a folder of our own taken.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not (sc.master or "").startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"/tmp/checkpoints/{os.getpid()}"


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for files that a query writes and reads again; it goes when the driver ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _gone_at_end(spark, folder)
    return folder


def _gone_at_end(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder, which outlive an executor."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
        _gone_at_end(df.sparkSession, sc.getCheckpointDir())
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Delete the files of a checkpoint that nothing reads any more: all that came of it is in later checkpoints."""
    sc = df.sparkSession.sparkContext
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def few(df: DataFrame, most: int) -> DataFrame:
    """``df`` to be broadcast if it has at most ``most`` rows, which is counted; else as it is, for a join by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df
