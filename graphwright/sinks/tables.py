"""Graphs and small records as partitioned Parquet tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import NODE_COLUMNS, Graph


def existing_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are nodes, once each."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "rel_type").distinct()


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    """Ids that occur more than once: none in a valid graph."""
    return nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("analysis_id").parquet(path)


def write_graph(g: Graph, path: str, analysis: str) -> None:
    """Replace one analysis; others under the path stay. Writing the same again changes nothing. The graph must not be read from this path.

    Both tables are written beside the old ones first and then take their places, so a write that fails leaves the old analysis as it is.
    """
    spark = g.nodes().sparkSession
    beside = f"{path}/_new-{uuid.uuid4().hex}"  # names that begin so are passed over by readers
    try:
        g.nodes().dropDuplicates(["id"]).sortWithinPartitions("id").write.parquet(f"{beside}/nodes")
        nodes = spark.read.parquet(f"{beside}/nodes")  # the ends of edges are looked up in what is written
        existing_ends(g.edges(), nodes).sortWithinPartitions("src", "dst").write.parquet(f"{beside}/edges")
        for table in ("nodes", "edges"):
            delete_partition(spark, f"{path}/{table}/analysis_id={analysis}")
            _move(spark, f"{beside}/{table}", f"{path}/{table}/analysis_id={analysis}")
    finally:
        delete_partition(spark, beside)


def _move(spark: SparkSession, source: str, target: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = hadoop(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(hadoop(target).getParent())
    if not system.rename(hadoop(source), hadoop(target)):
        raise OSError(f"could not move {source} to {target}")


def read_graph(spark: SparkSession, path: str, analysis: str) -> Graph:
    own = lambda t, schema: spark.read.schema(f"{schema}, analysis_id string").parquet(f"{path}/{t}").filter(F.col("analysis_id") == analysis)
    return Graph.of(own("nodes", ", ".join(f"{c} {kind}" for c, kind in NODE_COLUMNS.items())), own("edges", "src string, dst string, rel_type string"))


def delete_analysis(spark: SparkSession, path: str, analysis: str) -> None:
    """Remove the partitions of one analysis from both tables."""
    for table in ("nodes", "edges"):
        delete_partition(spark, f"{path}/{table}/analysis_id={analysis}")


def delete_partition(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def upsert(existing: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """existing with the rows of changes in place of those with equal keys."""
    return existing.join(changes.select(key), key, "left_anti").unionByName(changes)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of records by repository id, as one row each; a corrupt or empty file has none."""
    text = spark.read.text(path, wholetext=True)
    record = "map<string, struct<owner:string, name:string, branch:string, primary_language:string, file_count:bigint, total_lines:bigint>>"
    return text.select(F.explode(F.coalesce(F.from_json("value", record), F.map_from_arrays(F.array(), F.array()).cast(record)))).select(F.col("key").alias("repo_id"), "value.*")
