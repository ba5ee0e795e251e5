"""Bitmaps and seeded expansion against listing everything."""

import random

import pytest
from pyspark.sql import functions as F

from graphwright.model import CALLS, INHERITS
from graphwright.operators import impact, structure
from graphwright.plans import bitmaps
from graphwright.plans.traverse import around, far, reach, undirected, walk2, with_ids
from graphwright.sources.tables import project

from .test_graph import make


def pairs_of(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def graph(spark):
    """A hub that many call and that calls many, loops, edges both ways, and ends that are no nodes."""
    pick = random.Random(3)
    edges = {(f"n{i}", "hub", CALLS) for i in range(50)} | {("hub", f"m{i}", CALLS) for i in range(40)} | {("hub", "hub", CALLS), ("m1", "n1", INHERITS), ("n2", "n2", CALLS)}
    edges |= {(f"n{pick.randrange(60)}", f"n{pick.randrange(60)}", pick.choice((CALLS, INHERITS))) for _ in range(80)}
    return make(spark, sorted(edges), {f"n{i}": "Class" for i in range(0, 60, 3)} | {f"m{i}": "File" for i in range(20)})


@pytest.mark.parametrize("dense", [8, 10**9])
def test_bitmaps_reach_what_is_listed(graph, monkeypatch, dense):
    monkeypatch.setattr(bitmaps, "DENSE", dense)
    listed = pairs_of(walk2(with_ids(graph.edges())).select("target", "node"))
    for label in ("Function",) if dense == 8 else ("Class",):
        own = {r["id"] for r in graph.nodes(label).collect()}
        assert pairs_of(structure.downstream(graph, label)) == {p for p in listed if p[0] in own}
        assert pairs_of(structure.upstream(graph, label)) == {(b, a) for a, b in listed if b in own}
        counted = {r["target"]: r["dependency_count"] for r in structure.fan_in(graph, label).collect()}
        assert counted == {t: sum(a == t for a, _ in listed) for t in own if any(a == t for a, _ in listed)}


def test_impact_by_bitmaps_is_impact_by_rows(graph, monkeypatch):
    monkeypatch.setattr(bitmaps, "DENSE", 8)
    assert pairs_of(impact.impact_scores(graph, "Function")) == pairs_of(impact.impact_scores(graph, "Function", graph.nodes("Function").select("id")))


def test_numbers_are_dense_and_buckets_hold_one_label(spark):
    ids = spark.range(70_000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 40_000, "a").when(F.col("id") < 40_010, "b").alias("label"))
    found = bitmaps.numbered(ids.unionByName(ids.filter("label = 'a'").withColumn("label", F.lit(None).cast("string"))))
    rows = found.collect()
    assert len(rows) == 70_000 == len({r["n"] for r in rows})
    labels = {}
    for r in rows:
        labels.setdefault(r["n"] // bitmaps.BITS, set()).add(r["label"])
    assert all(len(x) == 1 for x in labels.values()) and max(labels) == 3
    assert pairs_of(bitmaps.numbered(ids.repartition(7)).select("id", "n")) == {(r["id"], r["n"]) for r in rows}


def test_bits_become_numbers(spark):
    held = [0, 1, 7, 8, 9, 31, 32, 63, 1000, 32_766, 32_767]
    maps = spark.createDataFrame([(x,) for x in held], "n long").agg(F.bitmap_construct_agg(F.col("n")).alias("m"))
    assert sorted(maps.select(bitmaps.numbers_of(F.col("m"), F.lit(2)).alias("x")).head()["x"]) == [2 * bitmaps.BITS + x for x in held]


@pytest.mark.parametrize("seed", range(2))
def test_seeded_trails_are_the_whole_ones(spark, seed):
    r = random.Random(seed)
    nodes = "abcdefghij"
    edges = sorted({(r.choice(nodes), r.choice(nodes), CALLS) for _ in range(8 + 7 * seed)})
    calls = undirected(with_ids(spark.createDataFrame(edges, "src string, dst string, rel_type string")))
    some = spark.createDataFrame([("a",), ("c",), ("nobody",)], "id string")
    assert pairs_of(far(calls, some)) == pairs_of(reach(calls, 2, 3, some))


def test_answers_for_one_target_are_those_for_all(spark):
    g = project(spark, "/root/testdata/sf0.001")
    for label in ("Function",):
        one = g.nodes(label).orderBy(F.desc("id")).limit(2).select("id").collect()
        seed = spark.createDataFrame(one, "id string")
        keep = [r["id"] for r in one]
        assert pairs_of(impact.change_simulation(g, label, seed)) == pairs_of(impact.change_simulation(g, label).filter(F.col("id").isin(keep)))
        assert pairs_of(impact.impact_scores(g, label, seed)) == pairs_of(impact.impact_scores(g, label).filter(F.col("target").isin(keep)))
        rows = impact.impact_rows(g, label).filter(F.col("target").isin(keep)).collect()
        for r in impact.impact_report(g, seed).collect():
            own = [x for x in rows if x["target"] == r["target"]]
            for kind, column in (("file", "files"), ("function", "functions"), ("class", "classes"), ("import", "imports")):
                assert r[column] == sorted({x["shown"] for x in own if x["type"] == kind and x["shown"]}) and r[f"{kind}_count"] == len({x["id"] for x in own if x["type"] == kind})
            assert (r["upstream_count"], r["downstream_count"], r["total_impacted"]) == (sum(x["side"] == "up" for x in own), sum(x["side"] == "down" for x in own), len({x["id"] for x in own}))


def test_one_target_reads_edges_behind_its_seed(spark, tmp_path):
    """Over stored tables: each scan of the edges is semi-joined by what was reached so far."""
    from graphwright.sinks import tables

    tables.write_graph(project(spark, "/root/testdata/sf0.001"), str(tmp_path), "a")
    arcs = with_ids(tables.read_graph(spark, str(tmp_path), "a").edges())
    near = around(arcs, spark.createDataFrame([("func:1",)], "id string"), 1)
    plan = near._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("LeftSemi") >= sum("FileScan" in x and "rel_type" in x for x in plan.splitlines()) / 6 > 0
    assert {r["a"] for r in near.collect()} <= {"func:1"} | {r["b"] for r in arcs.filter("a = 'func:1'").collect()}
