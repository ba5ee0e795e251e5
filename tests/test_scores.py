from pyspark.sql import functions as F

from graphwright.functions import scores
from graphwright.model import CALLS, NODE_COLUMNS, Graph


def test_bins_and_shares(spark):
    df = spark.createDataFrame([(v,) for v in (0, 25, 26, 35, 60, 75, 76, 120)], "x long")
    out = df.select("x", scores.page_severity(F.col("x")), scores.coupling(F.col("x")), scores.relevance(F.col("x"))).orderBy("x").collect()
    assert [r[1] for r in out] == ["low", "low", "medium", "medium", "high", "high", "critical", "critical"]
    assert [r[2] for r in out] == ["low", "low", "low", "medium", "high", "high", "high", "high"]
    assert [r[3] for r in out] == [0.0, 0.25, 0.26, 0.35, 0.6, 0.75, 0.76, 1.0]
    steps = spark.range(8).select(scores.understanding(F.col("id"))).collect()
    assert [r[0] for r in steps] == [50, 55, 65, 75, 85, 90, 90, 90]
    assert spark.range(1).select(scores.relevance(F.lit(None).cast("double"))).head()[0] == 0.0


def test_statement_with_parameters(spark):
    schema = ", ".join(f"{c} {t}" for c, t in NODE_COLUMNS.items())
    make = lambda i, name: tuple({"id": i, "label": "Function", "name": name}.get(c) for c in NODE_COLUMNS)
    nodes = spark.createDataFrame([make("a", "it's"), make("b", "other")], schema)
    edges = spark.createDataFrame([("a", "b", CALLS)], "src string, dst string, rel_type string")
    g = Graph.of(nodes, edges)
    found = g.sql("SELECT n.id, e.dst FROM {nodes} n LEFT JOIN {edges} e ON n.id = e.src WHERE n.name = :name", {"name": "it's"}).collect()
    assert [tuple(r) for r in found] == [("a", "b")]
