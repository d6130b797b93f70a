"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of this machine only in local sessions that name none, as in tests."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return base or f"{tempfile.gettempdir()}/checkpoints"


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{_shared(spark)}/scratch-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder, its lineage cut. With spark.cleaner.referenceTracking.cleanCheckpoints the session drops the files once nothing refers to them."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint()


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    system, p = _at(spark, path)
    return system.exists(p)


def drop(spark: SparkSession, path: str) -> None:
    system, p = _at(spark, path)
    system.delete(p, True)


def settled(df: DataFrame, folder: str) -> DataFrame:
    """df, computed and kept as a checkpoint, and the scratch folder that it was read from deleted."""
    out = checkpointed(df)
    drop(df.sparkSession, folder)
    return out
