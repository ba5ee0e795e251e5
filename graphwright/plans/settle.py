"""Frames that are read several times, written once."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session may do without: then a temporary folder, deleted when the driver ends."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not named:
            named = tempfile.mkdtemp(prefix="spark-settled-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df checkpointed now: later plans begin at its files, which outlive executors. Spark deletes them once nothing refers to them, where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    _shared(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written now as Parquet in the same folder: edges, whose ends repeat, take a tenth of a checkpoint's bytes. Deleted when the driver ends.

    The driver collects garbage afterwards, upon which Spark deletes the shuffle files of what was written.
    """
    spark = df.sparkSession
    path = f"{_shared(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
