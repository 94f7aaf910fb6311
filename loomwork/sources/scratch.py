"""Results between the steps of one operator, in the folder that the cluster shares."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only with a local master that has no such setting one of our own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not (sc.master or "").startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"/tmp/checkpoints/{os.getpid()}"


def _gone_at_end(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes when the driver ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _gone_at_end(spark, folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed and kept as files in the shared folder, which outlive an executor."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
        _gone_at_end(df.sparkSession, sc.getCheckpointDir())
    return df.checkpoint(eager=True)
