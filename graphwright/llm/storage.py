"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local session may do without: then a temporary folder, deleted when the driver ends."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN[app] = "file://" + folder
    return _OWN[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, name: str, sweep: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage (a lost executor costs only its running tasks) and fixes
    row placement, so values such as partition numbers can be relied on later.
    sweep: let the driver collect garbage afterwards, upon which Spark deletes the shuffle files of what was written; for steps
    that shuffle about as much as the input.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    if sweep:
        spark.sparkContext._jvm.System.gc()
    written = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[written] = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that materialize() returned, once nothing lazy needs them any more."""
    for table in tables:
        delete_path(table.sparkSession, _WRITTEN.pop(table))


def as_rows(documents: DataFrame, **more: Column) -> DataFrame:
    """documents as one struct column row beside the columns more, so that no name of the input's can clash. Undo by select("row.*")."""
    return documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), *(c.alias(name) for name, c in more.items()))


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Spark's own file system layer (works for any store)."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def list_path(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, through Spark's own file system layer; none where it does not exist."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in system.listStatus(hadoop)) if system.exists(hadoop) else []
