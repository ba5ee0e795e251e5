"""Tiles against listing everything, and what is no longer listed on the way."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphwright.model import CALLS, CONTAINS_FUNCTION, INHERITS, Graph
from graphwright.operators import impact, rules, structure
from graphwright.plans import tiles
from graphwright.plans.traverse import reach, undirected, with_ids
from graphwright.sources.tables import ENDS, project

from .test_graph import make


def pairs_of(df):
    return {tuple(r) for r in df.collect()}


def some(rng, n, most=3):
    out = np.zeros((tiles.SIDE, tiles.SIDE), np.uint8)
    out[rng.integers(0, 90, n), rng.integers(0, 90, n)] = rng.integers(1, most + 1, n)
    return out


@pytest.mark.parametrize("listed", [0, 10**9])
@pytest.mark.parametrize("n", [0, 1, 200, 4000])
def test_cells_are_matrices(monkeypatch, listed, n):
    monkeypatch.setattr(tiles, "LISTED", listed)
    rng = np.random.default_rng(n)
    x, y, z = (some(rng, n) for _ in range(3))
    a, b, c = map(tiles.packed_matrix, (x, y, z))
    assert (tiles.matrix(a) == x).all() and (tiles.matrix(tiles.turned(a)) == x.T).all()
    assert (tiles.matrix(tiles.added([a, b, c])) == np.minimum(x.astype(int) + y + z, 3)).all()
    assert (tiles.matrix(tiles.added([a, b, c], most=True)) == np.maximum(np.maximum(x, y), z)).all()
    plain = [(m > 0).astype(int) for m in (x, y, z)]
    assert (tiles.matrix(tiles.times(a, b)) == np.minimum(plain[0] @ plain[1], 3)).all()
    closed = plain[0] * (plain[1] @ plain[2]).T, plain[2] * (plain[0] @ plain[1]).T
    expected = [np.flatnonzero(closed[0].any(1)), np.flatnonzero(closed[0].any(0)), np.flatnonzero(closed[1].any(1))]
    assert all((got == want).all() for got, want in zip(tiles.on_cycle(a, b, c), expected))


def test_full_tiles():
    full = tiles.packed_matrix(np.full((tiles.SIDE, tiles.SIDE), 3, np.uint8))
    assert len(full) == 1 + 3 * tiles.PLANE and (tiles.matrix(full) == 3).all()
    assert (tiles.matrix(tiles.times(full, full)) == 3).all() and (tiles.matrix(tiles.times(full, full, 1)) == 1).all()


@pytest.fixture(scope="module")
def wide(spark):
    """2,600 nodes, so several tiles; a hub, triangles, edges both ways, loops."""
    pick = random.Random(5)
    edges = {(f"n{pick.randrange(2600)}", f"n{pick.randrange(2600)}", CALLS) for _ in range(3000)} | {("hub", f"n{k}", CALLS) for k in range(0, 2600, 3)} | {(f"n{k}", "hub", CALLS) for k in range(0, 2600, 50)}
    edges |= {("n1", "n1", CALLS), ("n2", "n5", CALLS), ("n5", "n2", CALLS)}
    return make(spark, sorted(edges), {f"n{k}": "Class" for k in range(0, 2600, 2)}), edges


def neighbours_of(edges):
    out, near = {}, {}
    for a, b, _ in edges:
        out.setdefault(a, set()).add(b)
        if a != b:
            near.setdefault(a, {}).setdefault(b, 0)
            near.setdefault(b, {}).setdefault(a, 0)
            near[a][b] += 1
            near[b][a] += 1
    return out, near


def test_cycles_over_several_tiles(wide):
    g, edges = wide
    out, near = neighbours_of(edges)
    expected = {(a, 2) for a in near for n in near[a].values() if n > 1} | {(a, 3) for a in near for b in near[a] if near[a].keys() & near[b].keys()}
    assert pairs_of(structure.closed_trails(g, None)) == expected
    assert [tuple(r) for r in structure.closed_trails(g, 7).collect()] == sorted(expected)[:7]
    into = {}
    for a, b, _ in edges:
        into.setdefault(b, set()).add(a)
    directed = {(a, 2) for a in out for b in out[a] if a in out.get(b, ())} | {(a, 3) for a in out for b in out[a] if into.get(a, set()) & out.get(b, set())}
    assert pairs_of(structure.directed_cycles(g)) == directed


def test_two_steps_over_several_tiles(wide):
    g, edges = wide
    out, _ = neighbours_of(edges)
    expected = {(a, b) for a, b, _ in edges} | {(a, c) for a in out for b in out[a] if a != b for c in out.get(b, ()) if b != c}
    own = {r["id"] for r in g.nodes("Function").select("id").collect()}
    assert pairs_of(structure.upstream(g, "Function")) == {(a, b) for a, b in expected if a in own}
    assert pairs_of(structure.downstream(g, "Function")) == {(b, a) for a, b in expected if b in own}


@pytest.mark.parametrize("seed", range(3))
def test_ends_of_trails_by_tiles(spark, seed):
    """Loops and edges both ways; names that are shared, empty or missing."""
    r = random.Random(seed)
    nodes = "abcdefghijkl"[: 5 + 3 * seed]
    edges = sorted({(r.choice(nodes), r.choice(nodes), CALLS) for _ in range(4 + 8 * seed)} | {("y", "z", CALLS), ("z", "y", CALLS), ("p", "q", CALLS), ("q", "r", CALLS)})
    g = make(spark, edges)
    name = F.when(F.col("id").isin("a", "b"), "same").when(F.col("id") == "c", "").when(F.col("id") == "d", None).otherwise(F.col("id"))
    g = Graph.of(g.nodes().withColumn("name", name), g.edges())
    ends = reach(undirected(with_ids(g.edges(CALLS))), 2, 3)
    expected = ends.join(g.nodes("Function").select(F.col("id").alias("node"), F.col("name").alias("value")), "node").select(F.col("start").alias("id"), "value")
    assert pairs_of(structure.call_neighbourhood(g)) == pairs_of(expected)
    every = g.nodes("Function").select("id")
    assert pairs_of(impact.change_simulation(g, "Function")) == pairs_of(impact.change_simulation(g, "Function", every))


def test_change_of_classes_and_files(spark):
    edges = [("f", "a", "FILE_CONTAINS_CLASS"), ("f", "x", CONTAINS_FUNCTION), ("a", "b", INHERITS), ("b", "c", INHERITS), ("x", "y", CALLS), ("y", "x", CALLS), ("f", "y", CONTAINS_FUNCTION)]
    g = make(spark, edges, {"f": "File", "a": "Class", "b": "Class", "c": "Class"})
    g = Graph.of(g.nodes().withColumn("rel_path", F.when(F.col("label") == "File", F.col("id"))), g.edges())
    for label in ("File", "Class", "Function"):
        assert pairs_of(impact.change_simulation(g, label)) == pairs_of(impact.change_simulation(g, label, g.nodes(label).select("id"))) != set()


def test_relations_that_ends_leave_out(spark):
    g = project(spark, "/root/testdata/sf0.001")
    assert g.circular() == (CONTAINS_FUNCTION, "FILE_CONTAINS_CLASS", INHERITS, CALLS)
    assert g.leading("File") == ("REPOSITORY_CONTAINS_FILE",) and g.leading("Function", back=True) == (CALLS,)
    assert not g.joined("Function", "Class", INHERITS, "FILE_CONTAINS_CLASS", CALLS) and g.joined("File", "Class", "FILE_CONTAINS_CLASS")
    free = Graph(g.node_parts, g.edge_parts)
    for f in (lambda x: structure.closed_trails(x, None), structure.function_hotspots):
        assert pairs_of(f(g)) == pairs_of(f(free))
    for relation, (a, b) in ENDS.items():
        edges = g.edges(relation)
        assert not edges.join(g.nodes(a).select(F.col("id").alias("src")), "src", "left_anti").count() and not edges.join(g.nodes(b).select(F.col("id").alias("dst")), "dst", "left_anti").count()


def joined_rows(spark, f):
    """Rows of the largest join of the statements that f runs, and whether one of them joined bitmaps by OR."""
    store = spark._jsparkSession.sharedState().statusStore()
    known = max((store.executionsList().apply(k).executionId() for k in range(store.executionsList().size())), default=-1)
    f().collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    most, ors = 0, False
    executions = store.executionsList()
    for e in (executions.apply(k) for k in range(executions.size())):
        if e.executionId() <= known:
            continue
        ors = ors or "bitmap_or_agg" in e.physicalPlanDescription()
        values, nodes = store.executionMetrics(e.executionId()), store.planGraph(e.executionId()).allNodes().iterator()
        while nodes.hasNext():
            node = nodes.next()
            if "Join" in node.name():
                metrics = node.metrics().iterator()
                while metrics.hasNext():
                    m = metrics.next()
                    if m.name() == "number of output rows" and (v := values.get(m.accumulatorId())).isDefined():
                        most = max(most, int(v.get().replace(",", "")))
    return most, ors


ASKED = {
    "r18_observations": lambda g: rules.signals(g, g.nodes().select(F.col("id").alias("key"), F.col("id").alias("category"))),
    "r20_impact_lists": lambda g: impact.impact_lists(g, "Function"),
    "r21_explanations": lambda g: impact.explanations(g, "Function"),
    "r23_summary": structure.summary,
    "x_directed_cycles": structure.directed_cycles,
    "r2_r3_change_simulation": lambda g: impact.change_simulation(g, "Function"),
    "q9_call_neighbourhood": structure.call_neighbourhood,
    "r4_architecture_risk": structure.architecture_risk,
    "r9_health": structure.health,
    "a3_function_hotspots": structure.function_hotspots,
    "a7_closed_trails": structure.closed_trails,
    "a5_excess_fan_in_functions": lambda g: structure.excess_fan_in(g, "Function"),
    "a13_onboarding": structure.onboarding,
    "a7_closed_trails_all": lambda g: structure.closed_trails(g, None),
    "r1_impact_scores": lambda g: impact.impact_scores(g, "Function"),
    "q6_downstream": lambda g: structure.downstream(g, "Function"),
    "q5_upstream": lambda g: structure.upstream(g, "Function"),
}


@pytest.fixture(scope="module")
def crowd(spark):
    """80 functions of which each calls all others: 6,320 calls, half a million walks of two steps; and a file."""
    g = make(spark, [(f"n{a}", f"n{b}", CALLS) for a in range(80) for b in range(80) if a != b] + [("file", "n0", CONTAINS_FUNCTION)], {"file": "File"})
    return Graph.of(g.nodes().withColumn("rel_path", F.when(F.col("label") == "File", F.lit("a/file"))), g.edges())


@pytest.mark.parametrize("name", ASKED)
def test_walks_of_a_crowd_are_not_listed(spark, crowd, name):
    """No join makes many more rows than there are calls, and no bitmap for each call is sorted."""
    rows, ors = joined_rows(spark, lambda: ASKED[name](crowd))
    assert 0 < rows <= 3 * 80 * 79 and not ors
