"""The graph and commit log that a star schema of Parquet tables describes.

region: repositories; nation: files; supplier: functions; customer: classes; part names supplied from a nation: its
imports; suppliers on adjacent lines of an order: calls; customer k inherits from k div 2; orders: commits; the brands and
names of an order's parts: the files of the commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CALLS, CONTAINS_CLASS, CONTAINS_FILE, CONTAINS_FUNCTION, IMPORTS, INHERITS, Graph


#: Ids begin with their label, so edges can't end elsewhere.
ENDS = {
    CONTAINS_FILE: ("Repository", "File"), CONTAINS_FUNCTION: ("File", "Function"), CONTAINS_CLASS: ("File", "Class"),
    IMPORTS: ("File", "Import"), INHERITS: ("Class", "Class"), CALLS: ("Function", "Function"),
}


def call_lines(lines: DataFrame) -> DataFrame:
    """(caller, callee) of every two adjacent lines of an order that differ, repeats included."""
    a = lines.select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("caller"))
    b = lines.select(F.col("l_orderkey").alias("order"), (F.col("l_linenumber") - 1).alias("before"), F.col("l_suppkey").alias("callee"))
    return a.join(b, (F.col("l_orderkey") == F.col("order")) & (F.col("line") == F.col("before"))).filter("caller <> callee").select("caller", "callee")


def project(spark: SparkSession, sf_dir: str) -> Graph:
    def t(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def key(prefix: str, column: str):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    def imported() -> DataFrame:
        lines = t("lineitem").select("l_suppkey", "l_partkey").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        return lines.select(F.col("s_nationkey").alias("nation"), F.col("p_name").alias("module")).distinct()

    def files() -> DataFrame:
        count = lambda df, k, c: df.groupBy(F.col(k).alias("nation")).agg(F.count(F.lit(1)).alias(c))
        base = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("nation", F.col("n_nationkey"))
        for part in (count(t("supplier"), "s_nationkey", "functions_count"), count(t("customer"), "c_nationkey", "classes_count"), count(imported(), "nation", "imports_count")):
            base = base.join(part, "nation", "left")
        counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("functions_count", "classes_count", "imports_count")]
        return base.select(key("file:", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat("r_name", F.lit("/"), "n_name").alias("rel_path"), *counts)

    def classes() -> DataFrame:
        methods = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
        joined = t("customer").join(methods, F.col("c_custkey") == F.col("o_custkey"), "left")
        return joined.select(key("class:", "c_custkey").alias("id"), F.col("c_name").alias("name"), key("file:", "c_nationkey").alias("file_id"), F.coalesce("n", F.lit(0)).alias("methods_count"))

    def calls() -> DataFrame:
        pairs = call_lines(t("lineitem")).distinct()
        return pairs.select(key("func:", "caller").alias("src"), key("func:", "callee").alias("dst"))

    def import_id():
        return F.concat(F.lit("import:"), F.col("nation").cast("string"), F.lit(":"), F.col("module"))

    node_parts = {
        "Repository": lambda: t("region").select(key("repo:", "r_regionkey").alias("id"), F.col("r_name").alias("name")),
        "File": files,
        "Function": lambda: t("supplier").select(key("func:", "s_suppkey").alias("id"), F.col("s_name").alias("name"), key("file:", "s_nationkey").alias("file_id")),
        "Class": classes,
        "Import": lambda: imported().select(import_id().alias("id"), "module", key("file:", "nation").alias("file_id")),
    }
    edge_parts = {
        CONTAINS_FILE: lambda: t("nation").select(key("repo:", "n_regionkey").alias("src"), key("file:", "n_nationkey").alias("dst")),
        CONTAINS_FUNCTION: lambda: t("supplier").select(key("file:", "s_nationkey").alias("src"), key("func:", "s_suppkey").alias("dst")),
        CONTAINS_CLASS: lambda: t("customer").select(key("file:", "c_nationkey").alias("src"), key("class:", "c_custkey").alias("dst")),
        IMPORTS: lambda: imported().select(key("file:", "nation").alias("src"), import_id().alias("dst")),
        INHERITS: lambda: t("customer").filter("c_custkey >= 2").select(key("class:", "c_custkey").alias("src"), F.concat(F.lit("class:"), F.expr("c_custkey div 2").cast("string")).alias("dst")),
        CALLS: calls,
    }

    def commits() -> DataFrame:
        joined = t("orders").join(t("customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
        return joined.select(F.col("o_orderkey").cast("string").alias("sha"), F.col("c_name").alias("author_name"), F.concat(F.upper("c_name"), F.lit("@example.com")).alias("author_email"),
                             F.col("o_orderdate").alias("committed_at"), (F.col("o_orderstatus") == "P").alias("is_merge"))

    def commit_files() -> DataFrame:
        joined = t("lineitem").select("l_orderkey", "l_partkey").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        return joined.select(F.col("l_orderkey").cast("string").alias("sha"), F.concat("p_brand", F.lit("/"), "p_name").alias("path")).distinct()

    return Graph(node_parts, edge_parts, commits, commit_files, t, ENDS)
