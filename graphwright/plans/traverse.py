"""Trails: paths that use no edge twice (nodes may repeat), as unrolled joins with pairwise edge inequality."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .settle import settled, stored


def with_ids(edges: DataFrame) -> DataFrame:
    """a, b, eid: an edge from a to b, with an identity that both directions share in undirected()."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.concat_ws("|", "src", "rel_type", "dst").alias("eid"))


def undirected(arcs: DataFrame) -> DataFrame:
    return arcs.unionByName(arcs.select(F.col("b").alias("a"), F.col("a").alias("b"), "eid"))


def trails(arcs: DataFrame, hops: int, starts: DataFrame | None = None) -> list[DataFrame]:
    """For each length 1..hops: start, node, used (edge ids). starts: a frame with id."""
    first = arcs if starts is None else arcs.join(starts.select(F.col("id").alias("a")).distinct(), "a")
    step = first.select(F.col("a").alias("start"), F.col("b").alias("node"), F.array("eid").alias("used"))
    found = [step]
    for _ in range(hops - 1):
        step = step.join(arcs, F.col("node") == F.col("a")).filter(~F.array_contains("used", F.col("eid")))
        step = step.select("start", F.col("b").alias("node"), F.concat("used", F.array("eid")).alias("used"))
        found.append(step)
    return found


def reach(arcs: DataFrame, low: int, high: int, starts: DataFrame | None = None) -> DataFrame:
    """Distinct (start, node) over trails of length low..high."""
    parts = [x.select("start", "node").distinct() for x in trails(arcs, high, starts)[low - 1 :]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct() if len(parts) > 1 else out


def around(arcs: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """The arcs that begin at seeds (a frame with id) or at what `hops` steps from them reach: all that a walk of hops + 1 steps from them can use.

    Each step is a semi-join of what was reached so far with the arcs, below any other operation, so the work follows the seeds' surroundings.
    """
    reached = seeds.select(F.col("id").alias("a")).distinct()
    for _ in range(hops):
        reached = reached.unionByName(arcs.join(reached, "a", "left_semi").select(F.col("b").alias("a"))).distinct()
    return arcs.join(reached, "a", "left_semi")


def walk2(arcs: DataFrame, ends: DataFrame | None = None, starts: DataFrame | None = None, but: DataFrame | None = None) -> DataFrame:
    """Distinct (node, target): node reaches target in one or two directed steps. starts and ends (frames with id) limit both before the join; nodes in but are no starts.

    Only a loop can be used twice in two steps, and a step over a loop adds no target that one step does not reach. So the
    second step needs no edge identities, only distinct pairs without loops.
    """
    pairs = arcs.select("a", "b").distinct()
    first = pairs if starts is None else pairs.join(starts.select(F.col("id").alias("a")).distinct(), "a", "left_semi")
    first = first if but is None else first.join(but.select(F.col("id").alias("a")), "a", "left_anti")
    last = pairs if ends is None else pairs.join(ends.select(F.col("id").alias("b")).distinct(), "b", "left_semi")
    one = first if ends is None else first.join(ends.select(F.col("id").alias("b")).distinct(), "b", "left_semi")
    before = first.filter("a <> b").select(F.col("a").alias("node"), F.col("b").alias("via"))
    after = last.filter("a <> b").select(F.col("a").alias("via"), F.col("b").alias("target"))
    two = before.join(after, "via").select("node", "target")
    return one.select(F.col("a").alias("node"), F.col("b").alias("target")).unionByName(two).distinct()


def near2(arcs: DataFrame, starts: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """Distinct (start, node) over undirected trails of length 1 or 2. arcs as undirected() gives them.

    As in walk2, but a step can turn back, which needs a second edge between the same two nodes.
    """
    found = walk2(arcs, ends, starts).withColumnsRenamed({"node": "start", "target": "node"})
    loops = arcs.filter("a = b").select("a")
    double = arcs.filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a")
    back = loops.unionByName(double).distinct()
    return found.join(back, (F.col("start") == F.col("a")) & (F.col("node") == F.col("a")), "left").filter("start <> node or a is not null").select("start", "node")


def far(arcs: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Distinct (start, node) over undirected trails of length 2 or 3. arcs as undirected() gives them. starts: a frame with id; then only their surroundings are read.

    For arcs with at most one loop at a node, as calls have. Trails are counted, not listed: walks of two and three steps between two nodes by sums over the numbers of edges, less the walks
    that use an edge twice. With m edges between s and t and d(s), d(t) edges at them, of the three-step walks d(s) m turn back at
    once, m d(t) at last, m m take one edge first and last, and m are in all three kinds: d(s) m + m d(t) + m m - 2 m in all.
    Starts that two steps take to every node are left out of the third. A loop adds the neighbours of its node, and its node to them.
    """
    arcs = arcs if starts is None else settled(around(arcs, starts, 2))  # all edges of what one or two steps reach; read many times below
    pairs = arcs.filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"))
    degree = pairs.groupBy("a").agg(F.sum("m").alias("d"))
    begin = pairs if starts is None else pairs.join(starts.select(F.col("id").alias("a")).distinct(), "a", "left_semi")
    ways = begin.select(F.col("a").alias("start"), F.col("b").alias("via"), F.col("m").alias("m1")).join(pairs.select(F.col("a").alias("via"), F.col("b").alias("node"), F.col("m").alias("m2")), "via")
    ways = ways.groupBy("start", "node").agg(F.sum(F.col("m1") * F.col("m2")).alias("w2"))
    at = degree.withColumnsRenamed({"a": "start", "d": "ds"})
    two = ways.join(at, "start").filter((F.col("start") != F.col("node")) | (F.col("w2") > F.col("ds"))).select("start", "node")
    reached = two.groupBy("start").agg(F.count(F.lit(1)).alias("n")).join(degree.agg(F.count(F.lit(1)).alias("all")))  # one row joined
    open_ = begin.select(F.col("a").alias("start")).distinct().join(reached.filter(F.col("n") == F.col("all")).select("start"), "start", "left_anti")
    on = ways.join(open_, "start", "left_semi").select("start", F.col("node").alias("via"), "w2").join(pairs.select(F.col("a").alias("via"), F.col("b").alias("node"), "m"), "via")
    on = on.groupBy("start", "node").agg(F.sum(F.col("w2") * F.col("m")).alias("w3"))
    direct = begin.withColumnsRenamed({"a": "start", "b": "node"}).join(at, "start").join(degree.withColumnsRenamed({"a": "node", "d": "dn"}), "node")
    twice = direct.select("start", "node", (F.col("m") * (F.col("ds") + F.col("dn") + F.col("m") - 2)).alias("twice"))
    three = on.join(twice, ["start", "node"], "left").filter(F.col("w3") > F.coalesce("twice", F.lit(0))).select("start", "node")
    loops = arcs.filter("a = b").select(F.col("a").alias("loop")).distinct()
    beside = pairs.join(loops, F.col("a") == F.col("loop"), "left_semi").select(F.col("a").alias("start"), F.col("b").alias("node"))
    out = two.unionByName(three).unionByName(beside).unionByName(beside.select(F.col("node").alias("start"), F.col("start").alias("node"))).distinct()
    return out if starts is None else out.join(starts.select(F.col("id").alias("start")).distinct(), "start", "left_semi")


def longest_chains(edges: DataFrame, at_least: int, keep: int, most: int | None = None) -> DataFrame:
    """depth, start, path of the `keep` longest trails of at least `at_least` edges (ties by path). With `most`, longer trails are an error.

    Levels grow backwards: level d holds, for each node, the first `keep` paths of d edges that begin there. A path's place among those
    of its node is that of its remainder among those of the next node, so no more are needed, however many trails there are. Only
    trails through cycles can use an edge twice: there, nodes are told apart by the edges of cycles that a trail has used (`cyclic`).
    """
    arcs = with_ids(edges)
    levels = _levels(arcs.withColumn("cyclic", F.lit(False)), keep, CYCLES_BY)
    if levels and len(levels) == CYCLES_BY:
        alive = levels[-1].select(F.col("node").alias("a")).distinct()  # what begins a walk of so many steps; cycles are among it
        core = settled(cyclic(arcs.join(alive, "a", "left_semi")).select("eid", F.lit(True).alias("cyclic")))
        _release(levels)
        marked = settled(arcs.join(core, "eid", "left").select("a", "b", "eid", F.coalesce("cyclic", F.lit(False)).alias("cyclic")))
        levels = _levels(marked, keep, None if most is None else most + 1)
    if most is not None and len(levels) > most:
        _release(levels)
        raise RuntimeError(f"chains have more than {most} edges")
    wanted = [x.select(F.lit(d).cast("long").alias("depth"), F.col("node").alias("start"), "path") for d, x in enumerate(levels, 1) if d >= at_least and d > len(levels) - keep]
    if not wanted:
        _release(levels)
        return edges.select(F.lit(0).cast("long").alias("depth"), F.col("src").alias("start"), F.col("dst").alias("path")).limit(0)
    out = settled(functools.reduce(DataFrame.unionByName, wanted).orderBy(F.desc("depth"), "path").limit(keep))
    _release(levels)
    return out.orderBy(F.desc("depth"), "path")


#: Walks of so many steps make longest_chains look for cycles; shorter ones end by themselves.
CYCLES_BY = 16


def _levels(arcs: DataFrame, keep: int, stop: int | None) -> list[DataFrame]:
    """node, used (edges of cycles), path: one frame for each length from 1, until no trail is longer or `stop` is reached. arcs: a, b, eid, cyclic.

    The last `keep` levels stay in memory or on disk; older ones are released. Every eighth is settled, so that a lost executor costs eight levels.
    """
    mark = F.when(F.col("cyclic"), F.array("eid")).otherwise(F.array().cast("array<string>"))
    first = Window.partitionBy("node", "used").orderBy("path")
    level = arcs.select(F.col("a").alias("node"), mark.alias("used"), F.concat_ws(">", "a", "b").alias("path"))
    levels: list[DataFrame] = []
    while stop is None or len(levels) < stop:
        level = level.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= keep).drop("place").persist()
        if (len(levels) + 1) % 8 == 0:
            written = stored(level)  # and the shuffle files of eight levels go
            level.unpersist()
            level = written
        if level.isEmpty():
            level.unpersist()
            break
        levels.append(level)
        if len(levels) > keep + 8:
            levels[-keep - 9].unpersist()
        before = arcs.join(level.withColumnRenamed("node", "b"), "b").filter(~F.col("cyclic") | ~F.array_contains("used", F.col("eid")))
        used = F.when(F.col("cyclic"), F.array_sort(F.concat("used", F.array("eid")))).otherwise(F.col("used"))
        level = before.select(F.col("a").alias("node"), used.alias("used"), F.concat_ws(">", "a", "path").alias("path"))
    return levels


def _release(levels: list[DataFrame]) -> None:
    for x in levels:
        x.unpersist()


def cyclic(arcs: DataFrame) -> DataFrame:
    """The arcs left once ends of no arc, or of none but arcs away from them, are taken off again and again: all arcs of cycles, and those on the way from one cycle to another."""
    left, n = arcs, arcs.count()
    while n:
        ends = left.select("a").distinct()
        begins = left.select(F.col("b").alias("a")).distinct()
        both = ends.join(begins, "a", "left_semi")
        left = settled(left.join(both, "a", "left_semi").join(both.withColumnRenamed("a", "b"), "b", "left_semi").select(arcs.columns))
        was, n = n, left.count()
        if n == was:
            break
    return left
