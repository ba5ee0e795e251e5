import random

import pytest
from pyspark.sql import functions as F

from graphwright.model import CALLS, INHERITS, Graph, as_nodes
from graphwright.operators import impact, structure
from graphwright.plans.traverse import cyclic, far, longest_chains, near2, reach, trails, undirected, walk2, with_ids
from graphwright.sources.tables import project


def make(spark, edges, labels=None):
    ids = sorted({x for a, b, _ in edges for x in (a, b)})
    labels = labels or {}
    nodes = spark.createDataFrame([(i, labels.get(i, "Function"), i) for i in ids], "id string, label string, name string")
    for c, t in (("rel_path", "string"), ("module", "string"), ("file_id", "string"), ("functions_count", "long"), ("classes_count", "long"), ("imports_count", "long"), ("methods_count", "long")):
        nodes = nodes.withColumn(c, F.lit(None).cast(t))
    return Graph.of(nodes, spark.createDataFrame(edges, "src string, dst string, rel_type string"))


def test_trails_use_no_edge_twice(spark):
    g = make(spark, [("x", "y", CALLS), ("y", "x", CALLS)])
    arcs = with_ids(g.edges())
    assert {tuple(r) for r in reach(arcs, 1, 2).collect()} == {("x", "y"), ("y", "x"), ("x", "x"), ("y", "y")}
    assert trails(arcs, 3)[2].count() == 0
    assert {tuple(r) for r in walk2(arcs).collect()} == {("x", "y"), ("y", "x"), ("x", "x"), ("y", "y")}


def test_undirected_steps_do_not_turn_back(spark):
    g = make(spark, [("a", "b", CALLS), ("b", "c", CALLS)])
    got = {tuple(r) for r in reach(undirected(with_ids(g.edges())), 2, 3).collect()}
    assert got == {("a", "c"), ("c", "a")}


def test_closed_trails(spark):
    g = make(spark, [("f", "x", "FILE_CONTAINS_FUNCTION"), ("f", "y", "FILE_CONTAINS_FUNCTION"), ("x", "y", CALLS), ("y", "z", CALLS), ("z", "y", CALLS)], {"f": "File"})
    assert {tuple(r) for r in structure.closed_trails(g, None).collect()} == {("f", 3), ("x", 3), ("y", 3), ("y", 2), ("z", 2)}
    assert {tuple(r) for r in structure.directed_cycles(g).collect()} == {("y", 2), ("z", 2)}


@pytest.mark.parametrize(("depth", "severity"), [(2, None), (3, "medium"), (6, "high")])
def test_inheritance_chains(spark, depth, severity):
    g = make(spark, [(f"c{i}", f"c{i + 1}", INHERITS) for i in range(depth)], {f"c{i}": "Class" for i in range(depth + 1)})
    found = structure.inheritance_chains(g).collect()
    assert (found[0]["severity"] if found else None) == severity
    assert not found or found[0]["depth"] == depth


def test_chains_end_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b", INHERITS), ("b", "a", INHERITS), ("a", "a", INHERITS)], "src string, dst string, rel_type string")
    assert max(r["depth"] for r in longest_chains(edges, 1, 3).collect()) == 3


@pytest.mark.parametrize(("seed", "rising"), [(0, True), (1, True), (2, False), (3, False), (4, False)])
def test_longest_chains_are_the_first_of_all_trails(spark, seed, rising):
    """Several parents, parallel edges of two types, and (not rising) cycles and loops."""
    r = random.Random(seed)
    nodes = "abcdefghijk"[: 11 if rising else 6]
    pairs = [(r.choice(nodes), r.choice(nodes)) for _ in range(22 if rising else 9)]
    edges = sorted({(*(sorted(p) if rising else p), r.choice((INHERITS, CALLS))) for p in pairs if not rising or p[0] != p[1]})
    arcs = with_ids(spark.createDataFrame(edges, "src string, dst string, rel_type string"))

    def grow(path, used):
        yield path, len(used)
        for a, b, kind in edges:
            if a == path[-1] and (a, b, kind) not in used:
                yield from grow([*path, b], used | {(a, b, kind)})

    every = sorted((-n, ">".join(p)) for x in nodes for p, n in grow([x], frozenset()) if n >= 2)
    for keep in (1, 3, 7):
        got = longest_chains(spark.createDataFrame(edges, "src string, dst string, rel_type string"), 2, keep).collect()
        assert [(-x["depth"], x["path"]) for x in got] == every[:keep]
        assert all(x["path"].split(">")[0] == x["start"] for x in got)
    if rising:
        assert not cyclic(arcs).count()


def test_longest_chains_with_three_parents_each_end(spark):
    """Ten thousand classes, three parents each, 40 levels and 3^40 trails: beyond CYCLES_BY, without cycles."""
    n, wide = 10_000, 250
    at = F.col("id")
    parents = F.array(*(F.concat(F.lit("c"), F.lpad((F.floor(at / wide) * wide + wide + (at * 7 + k * 83) % wide).cast("string"), 6, "0")) for k in range(3)))
    edges = spark.range(n - wide).select(F.concat(F.lit("c"), F.lpad(at.cast("string"), 6, "0")).alias("src"), F.explode(parents).alias("dst"), F.lit(INHERITS).alias("rel_type"))
    got = longest_chains(edges, 3, 3).collect()
    assert [x["depth"] for x in got] == [39] * 3 and [x["start"] for x in got] == ["c000000"] * 3
    assert sorted(x["path"] for x in got) == [x["path"] for x in got] and len({x["path"] for x in got}) == 3


@pytest.mark.parametrize(("degree", "severity"), [(8, None), (9, "medium"), (12, "medium"), (13, "high"), (20, "high"), (21, "critical")])
def test_fan_in_severity(spark, degree, severity):
    g = make(spark, [(f"n{i}", "t", CALLS) for i in range(degree)])
    found = {r["node"]: r["severity"] for r in structure.excess_fan_in(g, "Function").collect()}
    assert found.get("t") == severity


def test_invariants_of_the_projection(spark):
    g = project(spark, "/root/testdata/sf0.001")
    o = structure.overview(g).head()
    assert structure.totals(g).head()["total_nodes"] == sum(o)
    nodes, edges = g.nodes(), g.edges()
    assert nodes.select("id").distinct().count() == nodes.count()
    assert edges.distinct().count() == edges.count()
    assert edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti").count() == 0
    assert edges.join(nodes.select(F.col("id").alias("src")), "src", "left_anti").count() == 0


def test_calls_come_from_all_lines(spark):
    lines = {(r["l_orderkey"], r["l_linenumber"], r["l_suppkey"]) for r in spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").collect()}
    after = {}
    for order, line, supplier in lines:
        after.setdefault((order, line), set()).add(supplier)
    expected = {(f"func:{a}", f"func:{b}") for order, line, a in lines for b in after.get((order, line + 1), ()) if a != b}
    g = project(spark, "/root/testdata/sf0.001")
    assert {(r["src"], r["dst"]) for r in g.edges(CALLS).collect()} == expected
    out = {}
    for a, b in expected:
        out.setdefault(a, set()).add(b)
    cycles = {(a, 2) for a, b in expected if a in out.get(b, ())} | {(a, 3) for a, b in expected for c in out.get(b, ()) if a in out.get(c, ())}
    assert {tuple(r) for r in structure.directed_cycles(g).collect()} == cycles


def test_chains_beyond_the_bound_are_an_error(spark):
    edges = spark.createDataFrame([(f"c{i}", f"c{i + 1}", INHERITS) for i in range(4)], "src string, dst string, rel_type string")
    assert longest_chains(edges, 1, 1, most=4).head()["depth"] == 4
    with pytest.raises(RuntimeError):
        longest_chains(edges, 1, 1, most=3)


@pytest.mark.parametrize("seed", range(4))
def test_counted_trails_are_the_listed_ones(spark, seed):
    """Loops, edges both ways, edges of several types, and parts that are not connected."""
    r = random.Random(seed)
    nodes = "abcdefghij"[: 5 + 2 * seed]
    edges = {(r.choice(nodes), r.choice(nodes), r.choice((CALLS, INHERITS))) for _ in range(4 + 5 * seed)} | {("y", "z", CALLS)}
    arcs = with_ids(spark.createDataFrame(sorted(edges), "src string, dst string, rel_type string"))
    ways = undirected(arcs)
    pairs = lambda df: {tuple(x) for x in df.collect()}
    assert pairs(walk2(arcs)) == pairs(reach(arcs, 1, 2))
    assert pairs(near2(ways)) == pairs(reach(ways, 1, 2))
    some = spark.createDataFrame([(x,) for x in nodes[:3]], "id string")
    assert pairs(near2(ways, starts=some)) == pairs(reach(ways, 1, 2, some))
    calls = undirected(with_ids(spark.createDataFrame(sorted(e for e in edges if e[2] == CALLS), "src string, dst string, rel_type string")))
    assert pairs(far(calls)) == pairs(reach(calls, 2, 3))
    assert pairs(far(ways)) >= pairs(reach(ways, 2, 3).filter("start <> node"))


def test_call_chains_are_the_first_of_all_chains(spark):
    g = project(spark, "/root/testdata/sf0.001")
    out, name = {}, {x["id"]: x["name"] for x in g.nodes("Function").collect()}
    for e in g.edges(CALLS).collect():
        out.setdefault(e["src"], []).append(e["dst"])

    def chains(path, left):
        if len(path) > 1:
            yield len(path) - 1, " > ".join(name[x] for x in path)
        for x in out.get(path[-1], ()) if left else ():
            if (path[-1], x) not in zip(path, path[1:]):
                yield from chains([*path, x], left - 1)

    for part, hops, keep in (("/NATION_1", 4, 6), ("/NATION_2", 3, 40), ("/NATION_", 2, 10_000)):
        files = {x["id"] for x in g.nodes("File").filter(F.col("rel_path").contains(part)).collect()}
        starts = [x["id"] for x in g.nodes("Function").collect() if x["file_id"] in files]
        expected = sorted({c for s in starts for c in chains([s], hops)}, key=lambda c: (-c[0], c[1]))[:keep]
        got = structure.call_chains(g, g.nodes("File").filter(F.col("rel_path").contains(part)), hops, keep)
        assert [tuple(x) for x in got.collect()] == expected


@pytest.mark.parametrize("label", ["Repository", "File", "Function", "Class"])
def test_impact_sides_are_what_each_side_reaches(spark, label):
    g = project(spark, "/root/testdata/sf0.001")
    up = {(r.target, "up", r.id) for r in structure.upstream(g, label).collect()}
    down = {(r.target, "down", r.id) for r in structure.downstream(g, label).collect()}
    rows = impact.impact_rows(g, label).select("target", "side", "id").collect()
    known = {r.id for r in g.nodes().select("id").collect()}
    assert len(rows) == len(set(rows)) and {tuple(r) for r in rows} == {x for x in up | down if x[2] in known}


def test_primary_language_by_extension(spark):
    files = lambda *paths: Graph.of(as_nodes(spark.createDataFrame([(p, p) for p in paths], "id string, rel_path string"), "File"), spark.createDataFrame([], "src string, dst string, rel_type string"))
    top = lambda *paths: structure.primary_language(files(*paths)).head()
    assert tuple(top("a/x_y.py", "b.PY", "c.rs", "LICENSE", "NOTICE", "d/e.f/Makefile")) == ("Python", 2)
    assert tuple(top("c.rs", "b.tsx", "a.rs")) == ("RS", 2)
    assert tuple(top("LICENSE")) == ("Unknown", 1)
