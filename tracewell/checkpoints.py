"""Cutting plans by checkpoints: in a folder that all executors share, or on the executors' disks."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's shared folder; set one only where none is named, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tracewell-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """The rows, kept in the shared checkpoint folder: computed once, no plan behind them."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_local(df: DataFrame) -> DataFrame:
    """The rows, computed once, no plan behind them, kept by Spark on the disks of two executors. For many small results:
    each file in a shared folder that is a local one makes Hadoop start processes from the executor's JVM (chmod)."""
    one = df.sparkSession.sparkContext._jsc.sc().isLocal()
    return df.localCheckpoint(eager=True, storageLevel=StorageLevel.DISK_ONLY if one else StorageLevel.DISK_ONLY_2)
