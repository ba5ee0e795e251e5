"""Impact and change simulation, for every node of a label at once (filter on target for one)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import severity
from ..model import CALLS, CONTAINS_CLASS, INHERITS, Graph
from ..plans import tiles as tile
from ..plans.settle import settled, stored
from ..plans.traverse import around, walk2, with_ids
from .structure import call_neighbourhood, class_neighbourhood, display, far_tiles, neighbours, value_numbers


def impact_rows(g: Graph, label: str, of: DataFrame | None = None) -> DataFrame:
    """(target, side, id, shown, type): what is up- and downstream of each node of a label; a node can be both.

    of: a frame with the ids of the nodes that are asked for; then only edges around them are read, and no others are joined or made distinct.
    """
    arcs = with_ids(g.edges())
    if of is not None:
        back = arcs.select(F.col("b").alias("a"), F.col("a").alias("b"), "eid")
        up, down = (walk2(settled(around(x, of, 1)), starts=of) for x in (arcs, back))
        sides = up.select(F.col("node").alias("target"), F.lit("up").alias("side"), F.col("target").alias("id")).unionByName(down.select(F.col("node").alias("target"), F.lit("down").alias("side"), F.col("target").alias("id")))
        return sides.join(g.nodes().select("id", display().alias("shown"), F.lower("label").alias("type")), "id")
    own = g.nodes(label).select("id").distinct()
    # Pairs of two own nodes are many where own nodes call each other: they are found once and serve both ends.
    side = lambda target, name, other: F.struct(F.col(target).alias("target"), F.lit(name).alias("side"), F.col(other).alias("id"))
    out = walk2(arcs, starts=own).join(own.select(F.col("id").alias("mine")), F.col("target") == F.col("mine"), "left")
    ends = F.when(F.col("mine").isNotNull(), F.array(side("node", "up", "target"), side("target", "down", "node"))).otherwise(F.array(side("node", "up", "target")))
    sides = out.select(F.explode(ends).alias("x")).select("x.*").unionByName(walk2(arcs, ends=own, but=own).select("target", F.lit("down").alias("side"), F.col("node").alias("id")))
    return sides.join(g.nodes().select("id", display().alias("shown"), F.lower("label").alias("type")), "id")


def _sides(g: Graph, label: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of all nodes of a label (tiles.reached), and the numbers of nodes and other ends of edges with their type; other ends have none."""
    relations = tuple(dict.fromkeys(g.leading(label) + g.leading(label, back=True)))
    pairs = stored(g.edges(*relations).select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    types = g.nodes(*g.labels(relations)).groupBy("id").agg(F.max(F.lower("label")).alias("label"))
    numbers = tile.numbered(ends.join(types, "id", "left").select("id", F.coalesce("label", F.lit("")).alias("label")), pairs)
    own = tile.tile_labels(numbers).filter(F.col("label") == label.lower())
    return tile.reached(tile.tiled(tile.with_numbers(pairs, numbers)), own, both=True), numbers


def _side_counts(found: DataFrame, numbers: DataFrame) -> DataFrame:
    """Counts for each target, by tiles: no list of who reaches whom. Tiles hold one type."""
    rows = tile.row_counts(found).join(F.broadcast(tile.tile_labels(numbers).filter("label <> ''")), F.col("o") == F.col("tile"))  # a row for as many nodes as a tile has
    of = lambda k: F.sum(F.when(F.col("label") == k, F.col("up") + F.col("down")).otherwise(0))
    counts = rows.groupBy("n").agg(F.sum("up").alias("upstream_count"), F.sum("down").alias("downstream_count"), F.sum("total").alias("total_impacted"), of("file").alias("files"), of("class").alias("classes"), of("function").alias("functions"))
    return counts.join(numbers.select("n", F.col("id").alias("target")), "n")


def _impact_counts(g: Graph, label: str) -> DataFrame:
    return _side_counts(*_sides(g, label))


def _values(g: Graph, label: Column, numbers: DataFrame, *labels: str) -> tuple[DataFrame, DataFrame]:
    """For tiles of numbers the numbers of the names that their nodes show (tiles.valued), and the names' numbers, in the order of names within what label says."""
    shown = g.nodes(*labels).select("id", display().alias("shown"), label.alias("kind")).filter("shown is not null")
    names = tile.numbered(shown.select(F.col("shown").alias("id"), F.col("kind").alias("label")).distinct())
    of = shown.join(names.select(F.col("id").alias("shown"), F.col("label").alias("kind"), F.col("n").alias("q")), ["shown", "kind"]).select("id", "q")
    return tile.valued(numbers, of), names


def impact_scores(g: Graph, label: str, of: DataFrame | None = None) -> DataFrame:
    """Risk of each node (of those in the frame `of`): counts of both sides, files, classes and functions, each with its weight and limit."""
    n = lambda c: F.count_if(c)
    counts = _impact_counts(g, label) if of is None else impact_rows(g, label, of).groupBy("target").agg(
        n(F.col("side") == "up").alias("upstream_count"), n(F.col("side") == "down").alias("downstream_count"), F.count_distinct("id").alias("total_impacted"),
        n(F.col("type") == "file").alias("files"), n(F.col("type") == "class").alias("classes"), n(F.col("type") == "function").alias("functions"))
    return _scored(counts)


def _scored(counts: DataFrame) -> DataFrame:
    cap = lambda c, k, most: F.least(F.col(c) * k, F.lit(most))
    score = F.least(F.lit(100), 20 + cap("upstream_count", 4, 25) + cap("downstream_count", 5, 35) + F.col("files") * 2 + cap("classes", 3, 10) + cap("functions", 2, 8))
    return counts.select("target", "upstream_count", "downstream_count", "total_impacted", score.cast("long").alias("risk_score"), severity(score).alias("level"))


def impact_report(g: Graph, of: DataFrame) -> DataFrame:
    """One row for each target that has any impact: the sorted distinct names of each type on both sides, their numbers, and the totals of each side."""
    rows = impact_rows(g, "", of)
    kinds = {"file": "files", "function": "functions", "class": "classes", "import": "imports"}
    names = [F.array_sort(F.collect_set(F.when(F.col("type") == k, F.col("shown")))).alias(c) for k, c in kinds.items()]
    sizes = [F.count_distinct(F.when(F.col("type") == k, F.col("id"))).alias(f"{k}_count") for k in kinds]
    sides = [F.count_if(F.col("side") == s).alias(f"{s}stream_count") for s in ("up", "down")]
    return rows.groupBy("target").agg(*names, *sizes, *sides, F.count_distinct("id").alias("total_impacted"))


def impact_lists(g: Graph, label: str) -> DataFrame:
    """Sorted distinct names by type, as comma-joined text."""
    found, numbers = _sides(g, label)
    parts = {"file": 0, "function": 1}
    columns, names = _values(g, F.lower("label"), numbers, "File", "Function")
    both = tile.merged(tile.by_value(found, columns, {"up": 0, "down": 0})).drop("part")
    kinds = tile.tile_labels(names).select(F.col("tile").alias("v"), F.when(F.col("label") == "file", parts["file"]).otherwise(parts["function"]).alias("part"))
    texts = tile.texts(both.join(F.broadcast(kinds), "v"), tile.named(names), ",")  # a row for each tile
    whole = lambda part: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("v", "text")))), lambda x: x["text"]), ",")
    texts = texts.groupBy("n").agg(*(whole(part).alias(f"{kind}s") for kind, part in parts.items()))
    return _side_counts(found, numbers).select("n", "target").join(texts, "n", "left").select("target", *(F.coalesce(f"{kind}s", F.lit("")).alias(f"{kind}s") for kind in parts))


def explanations(g: Graph, label: str) -> DataFrame:
    """Level and the first three names up- and downstream."""
    found, numbers = _sides(g, label)
    columns, names = _values(g, F.lit(""), numbers, *g.labels(g.leading(label) + g.leading(label, back=True)))
    sides = {"up": 0, "down": 1}
    few = tile.firsts(tile.merged(tile.by_value(found, columns, sides)), tile.named(names), 3)
    first = lambda part: F.array_join(F.slice(F.array_sort(F.collect_set(F.when(F.col("part") == part, F.col("value")))), 1, 3), ", ")
    texts = few.groupBy("n").agg(*(first(part).alias(side) for side, part in sides.items())).join(numbers.select("n", F.col("id").alias("target")), "n")
    text = F.concat(F.col("level"), F.lit(" risk; uses "), *(x for side, before in (("up", ""), ("down", "; used by ")) for x in (F.lit(before), F.coalesce(side, F.lit("")))))
    return _scored(_side_counts(found, numbers)).join(texts, "target", "left").select("target", text.alias("explanation"))


def change_parts(g: Graph, label: str, of: DataFrame | None = None) -> DataFrame:
    """(id, part, value): displayed names that a change of each node of a label (of those in the frame `of`) touches."""
    part = lambda df, name: df.select("id", F.lit(name).alias("part"), "value")
    parts = part(neighbours(g, "File", "rel_path", of), "file").unionByName(part(neighbours(g, "Function", "name", of), "function")).unionByName(part(call_neighbourhood(g, of), "indirect")).unionByName(part(class_neighbourhood(g, label, of), "class"))
    return parts.join(g.nodes(label).select("id"), "id", "left_semi") if of is None else parts


def change_simulation(g: Graph, label: str, of: DataFrame | None = None) -> DataFrame:
    """Risk and blast radius of changing each node of a label (of those in the frame `of`). Equal displayed names count once in the radius."""
    if of is None:
        counts = _change_counts(g, label)
    else:
        n = lambda p: F.count_if(F.col("part") == p)
        direct = F.when(F.col("part").isin("file", "function"), F.col("value"))
        counts = change_parts(g, label, of).groupBy("id").agg(
            n("file").alias("f"), n("function").alias("g"), n("indirect").alias("h"), n("class").alias("c"),
            F.count_distinct(direct).alias("direct"), F.count_distinct("value").alias("total"))
    score = F.least(F.lit(100), F.greatest(F.lit(20), 8 * F.col("f") + 7 * F.col("g") + 4 * F.col("h") + 5 * F.col("c") + 15))
    return counts.select("id", "direct", F.col("h").alias("indirect"), "total", score.cast("long").alias("risk_score"))


def _change_counts(g: Graph, label: str) -> DataFrame:
    """What change_parts() lists, counted for all nodes of a label by tiles whose columns are displayed names. The null name is in its own part only, not in direct or total."""
    near = g.beside(label, "File", "Function")
    pairs = stored(g.edges(*dict.fromkeys((CALLS, *near))).select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("rel_type") == CALLS).alias("call"), F.col("rel_type").isin(*near).alias("near")))
    own = g.nodes(label).select("id").distinct().withColumn("label", F.lit("own"))
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(own.select("id")).distinct()
    numbers = tile.numbered(ends.join(own, "id", "left").select("id", F.coalesce("label", F.lit("")).alias("label")), pairs)
    mine = F.broadcast(tile.tile_labels(numbers).filter("label = 'own'").select(F.col("tile").alias("t")))  # a row for as many nodes as a tile has
    files, functions = (g.nodes(x).select("id", F.col(c).alias("value")) for x, c in (("File", "rel_path"), ("Function", "name")))
    kinds = [files, functions]
    if touching := g.joined(label, "Class", INHERITS, CONTAINS_CLASS, CALLS):
        classes = stored(class_neighbourhood(g, label))
        shown = F.coalesce(F.concat(F.lit("="), F.col("value")), F.lit(""))
        kinds.append(classes.select(shown.alias("id"), "value").distinct())
    q, names = value_numbers(functools.reduce(DataFrame.unionByName, (x.select(F.concat(F.lit(f"{k}:"), F.col("id")).alias("id"), "value") for k, x in enumerate(kinds))))
    q = stored(q)
    of_kind = lambda k, x: x.join(q.filter(F.startswith("id", F.lit(f"{k}:"))).select(F.substring("id", 3, 1 << 30).alias("id"), "q"), "id").select("id", "q")
    named = lambda x: x.filter("value is not null and value <> ''").select("id")
    both = lambda x: x.unionByName(x.select(F.col("y").alias("x"), F.col("x").alias("y")))
    beside = tile.tiled(both(tile.with_numbers(pairs.filter("near").select("a", "b"), numbers))).withColumnsRenamed({"i": "t", "j": "o"}).join(mine, "t", "left_semi")
    far = far_tiles(tile.with_numbers(pairs.filter("call").select("a", "b"), numbers)).join(mine, "t", "left_semi")
    parts = tile.by_value(beside, tile.valued(numbers, of_kind(0, named(files))), {"cells": 0}).unionByName(tile.by_value(beside, tile.valued(numbers, of_kind(1, named(functions))), {"cells": 1}))
    parts = parts.unionByName(tile.by_value(far, tile.valued(numbers, of_kind(1, functions.select("id"))), {"cells": 2}))
    if touching:
        cells = classes.join(numbers.select("id", F.col("n").alias("x")), "id").select("x", F.concat(F.lit("2:"), shown).alias("key"))
        cells = tile.tiled(cells.join(q.select(F.col("id").alias("key"), F.col("q").alias("y")), "key").select("x", "y"))
        parts = parts.unionByName(cells.select(F.col("i").alias("t"), F.col("j").alias("v"), F.lit(3).alias("part"), "cells"))
    counts = tile.part_counts(parts, {"f": (0,), "g": (1,), "h": (2,), "c": (3,), "direct": (0, 1), "total": (0, 1, 2, 3)})
    counts = counts.join(F.broadcast(tile.tile_labels(names)), F.col("v") == F.col("tile"))  # a row for as many values as a tile has
    is_named = lambda c: F.sum(F.when(F.col("label") == "", F.col(c)).otherwise(0)).alias(c)
    counts = counts.groupBy("n").agg(*(F.sum(c).alias(c) for c in "fghc"), is_named("direct"), is_named("total"))
    return counts.join(numbers.filter("label = 'own'").select("n", "id"), "n")


def critical_files(g: Graph, keep: int = 5) -> DataFrame:
    """Top files with the share of functions that their fan-in puts at stake; whole numbers are cut off, not rounded."""
    from .structure import file_hotspots

    sizes = g.nodes("File", "Function").agg(F.count_if(F.col("label") == "File").alias("files"), F.count_if(F.col("label") == "Function").alias("fns"))
    top = file_hotspots(g, keep).crossJoin(sizes)  # at most keep rows, and one row
    fan, share = F.col("dependency_count"), F.least(F.lit(99), (F.col("dependency_count") / F.col("files") * 100).cast("long"))
    return top.select("name", F.least(F.col("fns"), (fan * F.col("fns") / F.col("files")).cast("long")).alias("affected_functions"), F.least(fan, F.col("files")).alias("affected_modules"),
                      F.when(share > 0, share).alias("execution_pct"))
