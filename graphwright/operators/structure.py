"""Structural reads and analytics over a Graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import COMPLEXITY, FAN_IN_SEVERITY, binned, clamp
from ..model import CALLS, CONTAINS_CLASS, INHERITS, LABELS, RELATIONS, Graph
from ..plans import bitmaps
from ..plans import tiles as tile
from ..plans.settle import settled, stored
from ..plans.traverse import around, far, longest_chains, near2, undirected, walk2, with_ids


def display() -> Column:
    """What a node is shown as: its path for files, its module for imports, else its name."""
    return F.when(F.col("label") == "File", F.col("rel_path")).when(F.col("label") == "Import", F.col("module")).otherwise(F.col("name"))


def nodes_scan(g: Graph) -> DataFrame:
    return g.nodes().select("id", display().alias("label"), F.lower("label").alias("type"), "functions_count", "classes_count", "imports_count")


def edges_scan(g: Graph) -> DataFrame:
    """Edges whose ends both exist."""
    ids = g.nodes().select("id")
    held = g.edges().join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return held.select(F.concat_ws("-", "src", "rel_type", "dst").alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"), F.col("rel_type").alias("type"))


def whole_graph(g: Graph) -> DataFrame:
    nodes = nodes_scan(g).select(F.lit("node").alias("kind"), "id", "type")
    return nodes.unionByName(edges_scan(g).select(F.lit("edge").alias("kind"), "id", "type"))


def find_target(g: Graph, text: str) -> DataFrame:
    """The first node (by id) with text in its name, path or module; case matters."""
    hit = F.lit(False)
    for c in ("name", "rel_path", "module"):
        hit = hit | F.coalesce(F.col(c).contains(text), F.lit(False))
    return g.nodes().filter(hit).select("id", display().alias("label"), F.lower("label").alias("type")).orderBy("id").limit(1)


def settled_pairs(g: Graph, label: str | None = None, back: bool = False) -> DataFrame:
    """Different (a, b) of edges, stored; back turns them round. label: only those that one or two steps to it can use."""
    a, b = ("dst", "src") if back else ("src", "dst")
    edges = g.edges(*(RELATIONS if label is None else g.leading(label, back)))
    return stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())


def _tiles(pairs: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What reaches targets in one or two steps (tiles.reached, rows are targets), and the numbers of what has an edge. pairs: a, b, stored."""
    own = targets.select("id").distinct().withColumn("own", F.lit("own"))
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    numbers = tile.numbered(ids.join(own, "id", "left").select("id", F.coalesce("own", F.lit("")).alias("label")), pairs)
    edges = tile.with_numbers(pairs, numbers)
    return tile.reached(tile.tiled(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))), tile.tile_labels(numbers).filter("label = 'own'")), numbers


def _reaching(pairs: DataFrame, targets: DataFrame) -> DataFrame:
    if bitmaps.sparse(pairs, targets):
        return walk2(pairs, targets).select("target", F.col("node").alias("id"))
    found, numbers = _tiles(pairs, targets)
    names = tile.named(numbers)
    return tile.listed(found, "up", ("t", names), ("o", names), ("target", "id"))


def upstream(g: Graph, label: str) -> DataFrame:
    """(target, id): what every node of a label reaches in one or two directed steps."""
    return _reaching(settled_pairs(g, label, back=True), g.nodes(label))


def downstream(g: Graph, label: str) -> DataFrame:
    """(target, id): what reaches every node of a label in one or two directed steps."""
    return _reaching(settled_pairs(g, label), g.nodes(label))


def fan_in(g: Graph, label: str) -> DataFrame:
    """(target, dependency_count): how many nodes reach each node of a label in one or two directed steps; none is no row."""
    pairs, targets = settled_pairs(g, label), g.nodes(label)
    if bitmaps.sparse(pairs, targets):
        return walk2(pairs, targets).groupBy("target").agg(F.count(F.lit(1)).alias("dependency_count"))
    found, numbers = _tiles(pairs, targets)
    counts = tile.row_counts(found).groupBy("n").agg(F.sum("up").alias("dependency_count"))
    return counts.join(numbers, "n").select(F.col("id").alias("target"), "dependency_count")


def neighbours(g: Graph, label: str, shown: str, of: DataFrame | None = None) -> DataFrame:
    """(id, value): distinct names of a node's neighbours, in either direction, that have a label. of: a frame with the ids of the nodes that are asked for."""
    arcs = undirected(with_ids(g.edges()))
    arcs = arcs if of is None else arcs.join(of.select(F.col("id").alias("a")), "a", "left_semi")
    ends = g.nodes(label).select(F.col("id").alias("b"), F.col(shown).alias("value"))
    return arcs.join(ends, "b").filter("value is not null and value <> ''").select(F.col("a").alias("id"), "value").distinct()


def call_neighbourhood(g: Graph, of: DataFrame | None = None) -> DataFrame:
    """(id, value): names of functions at the end of undirected call trails of length 2 or 3. Without `of` for all functions, by tiles."""
    functions = g.nodes("Function").select("id", F.col("name").alias("value"))
    if of is not None:
        return far(undirected(with_ids(g.edges(CALLS))), of).join(functions.withColumnRenamed("id", "node"), "node").select(F.col("start").alias("id"), "value").distinct()
    arcs, numbers = _numbered_arcs(g.edges(CALLS))
    q, names = value_numbers(functions)
    found = tile.merged(tile.by_value(far_tiles(arcs), tile.valued(numbers, q), {"cells": 0}))
    return tile.listed(found, "cells", ("t", tile.named(numbers)), ("v", tile.named(names)), ("id", "value"))


def far_tiles(calls: DataFrame) -> DataFrame:
    """tiles.far of calls, numbered: x, y."""
    arcs = calls.filter("x <> y")
    tiles = tile.tiled(arcs.unionByName(arcs.select(F.col("y").alias("x"), F.col("x").alias("y"))))
    return tile.far(tiles, calls.filter("x = y").select(F.col("x").alias("n")).distinct())


def value_numbers(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, q): the number of each id's value, equal values with the same; and the values' numbers, of which null has one with a label of its own. values: id, value."""
    key = F.coalesce(F.concat(F.lit("="), F.col("value")), F.lit(""))
    names = tile.numbered(values.select(key.alias("id")).distinct().withColumn("label", F.when(F.col("id") == "", "null").otherwise("")))
    q = values.select("id", key.alias("key")).join(names.select(F.col("id").alias("key"), F.col("n").alias("q")), "key").select("id", "q")
    return q, names.select(F.when(F.col("id") != "", F.substring("id", 2, 1 << 30)).alias("id"), "label", "n")


def class_neighbourhood(g: Graph, start: str = "File", of: DataFrame | None = None) -> DataFrame:
    """(id, value): classes within two undirected hops over inheritance, class containment and calls."""
    arcs = undirected(with_ids(g.edges(INHERITS, CONTAINS_CLASS, CALLS)))
    found = near2(arcs, g.nodes(start), g.nodes("Class")) if of is None else near2(settled(around(arcs, of, 1)), of, g.nodes("Class"))
    return found.join(g.nodes("Class").select(F.col("id").alias("node"), F.col("name").alias("value")), "node").select(F.col("start").alias("id"), "value").distinct()


def overview(g: Graph) -> DataFrame:
    return g.nodes().agg(*(F.count_if(F.col("label") == x).alias(f"{x.lower()}_count") for x in LABELS))


def totals(g: Graph) -> DataFrame:
    """Nodes and edges by an outer join, so nodes without edges count."""
    out = g.edges().select(F.col("src").alias("id"), F.concat_ws("|", "src", "rel_type", "dst").alias("eid"))
    return g.nodes().select("id").join(out, "id", "left").agg(F.count_distinct("id").alias("total_nodes"), F.count_distinct("eid").alias("total_edges"))


def call_chains(g: Graph, entry_files: DataFrame, hops: int = 4, keep: int = 6) -> DataFrame:
    """The longest call chains (up to `hops`) from functions of the entry files: hops and path of names; ties by path.

    Chains are not all listed. A node is sure for n more steps if it has at least `hops` calls to nodes that are sure for n - 1, so
    that one of them is always unused. Once `keep` different chains end in nodes that are sure for the steps left, no chain whose path
    sorts after theirs can be among the first, and those are left out (names hold no characters before the blank).
    """
    names = g.nodes("Function").select("id", "name")
    starts = g.nodes("Function").join(entry_files.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    calls = with_ids(g.edges(CALLS))
    arcs = calls.join(names.select(F.col("id").alias("b"), F.col("name").alias("to_name")), "b")
    sure = [names.select(F.col("id").alias("safe"))]
    for _ in range(hops):
        on = arcs.join(sure[-1], F.col("b") == F.col("safe"), "left_semi").groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        sure.append(on.filter(F.col("n") >= hops).select(F.col("a").alias("safe")))
    step = starts.select(F.col("id").alias("node"), F.array().cast("array<string>").alias("used"), F.col("name").alias("path"))
    found = None
    for n in range(1, hops + 1):
        step = step.join(arcs, F.col("node") == F.col("a")).filter(~F.array_contains("used", F.col("eid")))
        step = step.select(F.col("b").alias("node"), F.concat("used", F.array("eid")).alias("used"), F.concat_ws(" > ", "path", "to_name").alias("path"))
        certain = step.join(sure[hops - n], F.col("node") == F.col("safe"), "left_semi").select("path").distinct().orderBy("path").limit(keep)
        bound = certain.agg(F.max("path").alias("last"), F.count(F.lit(1)).alias("certain"))
        step = step.join(F.broadcast(bound)).filter((F.col("certain") < keep) | (F.col("path") <= F.col("last"))).drop("last", "certain")  # one row joined
        level = step.select(F.lit(n).cast("long").alias("hops"), "path")
        found = level if found is None else found.unionByName(level)
    return found.distinct().orderBy(F.desc("hops"), "path").limit(keep)


def properties(g: Graph) -> DataFrame:
    """Bulk read, without the caps of a server: label, name or path, counts."""
    return g.nodes("File", "Function", "Class", "Import").select("id", "label", display().alias("shown"), "functions_count", "classes_count", "imports_count", "methods_count")


def focus(g: Graph, node_id: str) -> DataFrame:
    """A node and its neighbours in both directions."""
    arcs = undirected(with_ids(g.edges())).filter(F.col("a") == node_id).select(F.col("b").alias("id"))
    return arcs.unionByName(g.nodes().filter(F.col("id") == node_id).select("id")).distinct()


def sidebar(g: Graph, kind: str, text: str) -> DataFrame:
    found = nodes_scan(g).filter((F.col("type") == kind) & F.lower("label").contains(text.lower()))
    return found.select("id", "label", "type")


def node_types(g: Graph) -> DataFrame:
    return g.nodes().select(F.lower("label").alias("type")).distinct()


def type_counts(g: Graph) -> DataFrame:
    return g.nodes().groupBy(F.lower("label").alias("type")).agg(F.count(F.lit(1)).alias("n"))


def palette(g: Graph, text: str) -> DataFrame:
    """Entries that hold text, grouped by type: how many, and the first three."""
    rank = Window.partitionBy("type").orderBy("label", "id")
    found = nodes_scan(g).filter(F.lower("label").contains(text.lower())).withColumn("place", F.row_number().over(rank))
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "label")))), lambda x: x["label"]), ",")
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("n"), first.alias("first_three"))


def _module(shown: str, root: str) -> Column:
    return F.when(F.col(shown).contains("/"), F.split_part(F.col(shown), F.lit("/"), F.lit(1))).otherwise(root)


def major_modules(g: Graph, keep: int | None = 8) -> DataFrame:
    files = g.nodes("File").filter("rel_path is not null").groupBy(_module("rel_path", "root").alias("module_name"))
    sums = [F.sum(F.coalesce(f"{c}_count", F.lit(0))).alias(f"{c}_total") for c in ("functions", "classes", "imports")]
    out = files.agg(F.count_distinct("id").alias("file_count"), *sums).orderBy(F.desc("file_count"), "module_name")
    return out if keep is None else out.limit(keep)


def hotspots(g: Graph, label: str, complexity: Column, keep: int | None = 5) -> DataFrame:
    """Nodes of a label by the number of nodes that reach them in one or two steps; criticality is the share of the largest."""
    degree = fan_in(g, label)
    found = g.nodes(label).join(degree, F.col("id") == F.col("target")).select("id", display().alias("name"), "dependency_count", complexity.cast("long").alias("complexity"))
    if keep is not None:
        found = found.orderBy(F.desc("dependency_count"), "id").limit(keep)
    if keep is None:
        return found
    largest = F.max("dependency_count").over(Window.partitionBy(F.lit(1)))  # over the few rows kept
    return found.withColumn("criticality", F.round(F.col("dependency_count") / F.greatest(F.lit(1), largest), 6))


def file_hotspots(g: Graph, keep: int | None = 5) -> DataFrame:
    return hotspots(g, "File", F.coalesce(F.col("functions_count"), F.lit(0)) + F.coalesce(F.col("classes_count"), F.lit(0)), keep)


def function_hotspots(g: Graph, keep: int | None = 5) -> DataFrame:
    return hotspots(g, "Function", F.lit(0), keep)


def class_hotspots(g: Graph, keep: int | None = 5) -> DataFrame:
    return hotspots(g, "Class", F.coalesce(F.col("methods_count"), F.lit(0)), keep)


def excess_fan_in(g: Graph, label: str = "File", over: int = 8, keep: int = 5) -> DataFrame:
    degree = fan_in(g, label).withColumnRenamed("dependency_count", "incoming_degree").filter(F.col("incoming_degree") > over)
    top = degree.orderBy(F.desc("incoming_degree"), "target").limit(keep)
    return top.select(F.col("target").alias("node"), "incoming_degree", binned(F.col("incoming_degree"), FAN_IN_SEVERITY, "medium", strict=True).alias("severity"))


def inheritance_chains(g: Graph, at_least: int = 3, keep: int = 3) -> DataFrame:
    found = longest_chains(g.edges(INHERITS), at_least, keep)
    return found.withColumn("severity", F.when(F.max("depth").over(Window.partitionBy(F.lit(1))) > 5, "high").otherwise("medium"))


def closed_trails(g: Graph, keep: int | None = 5) -> DataFrame:
    """(node, cycle_length): nodes that an undirected trail of length 2 or 3 leads back to (loops aside).

    Length 2 is a pair of nodes with two edges; length 3 is a triangle. Neither triangles nor pairs of neighbours are listed: tiles of the
    matrix of edges tell which nodes are on one (`plans/tiles.py`).
    """
    arcs, numbers = _numbered_arcs(g.edges(*g.circular()).filter("src <> dst"))
    tiles = tile.tiled(arcs.unionByName(arcs.select(F.col("y").alias("x"), F.col("x").alias("y"))))
    out = _on(numbers, tile.repeated(tiles), 2).unionByName(_on(numbers, tile.on_cycles(tiles), 3))
    return out if keep is None else out.orderBy("node", "cycle_length").limit(keep)


def directed_cycles(g: Graph) -> DataFrame:
    """(node, cycle_length): functions on a directed call cycle of two or three steps. Not part of the reference."""
    arcs, numbers = _numbered_arcs(g.edges(CALLS))
    tiles = tile.tiled(arcs)
    return _on(numbers, tile.on_two(tiles), 2).unionByName(_on(numbers, tile.on_cycles(tiles), 3))


def _numbered_arcs(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges as pairs of numbers, and the numbers of what they join."""
    pairs = stored(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    numbers = tile.numbered(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct().withColumn("label", F.lit("")), pairs)
    return tile.with_numbers(pairs, numbers), numbers


def _on(numbers: DataFrame, found: DataFrame, length: int) -> DataFrame:
    return numbers.join(found, "n", "left_semi").select(F.col("id").alias("node"), F.lit(length).cast("long").alias("cycle_length"))


def coupled_files(g: Graph, over: int = 5, keep: int = 5) -> DataFrame:
    """Files by imports (exports are never recorded) above a limit."""
    score = F.coalesce("imports_count", F.lit(0))
    return g.nodes("File").filter("rel_path is not null").select(F.col("rel_path").alias("file"), score.alias("coupling_score")).filter(F.col("coupling_score") > over).orderBy(F.desc("coupling_score"), "file").limit(keep)


def degree_hotspots(g: Graph, keep: int = 6) -> DataFrame:
    """Files, functions and classes by edges in and out plus their function and import counts."""
    edges = g.edges()
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    nodes = g.nodes("File", "Function", "Class").join(ends, "id", "left")
    score = F.coalesce("degree", F.lit(0)) + F.coalesce("functions_count", F.lit(0)) + F.coalesce("imports_count", F.lit(0))
    return nodes.select("id", display().alias("name"), score.alias("score")).orderBy(F.desc("score"), "id").limit(keep)


def fallback_modules(g: Graph, keep: int = 6) -> DataFrame:
    path = F.coalesce("rel_path", "name")
    files = g.nodes("File").withColumn("shown", path)
    return files.groupBy(_module("shown", "(root)").alias("module")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "module").limit(keep)


def counts(g: Graph) -> DataFrame:
    """One row: nodes, edges and nodes of each kind."""
    n = g.nodes().agg(F.count(F.lit(1)).alias("nodes"), *(F.count_if(F.col("label") == x).alias(f"{x.lower()}_nodes") for x in LABELS))
    return n.crossJoin(g.edges().agg(F.count(F.lit(1)).alias("edges")))  # one row each


def density(g: Graph) -> DataFrame:
    return counts(g).select("nodes", "edges", F.round(F.col("edges") / F.nullif(F.col("nodes") * (F.col("nodes") - 1), F.lit(0)), 9).alias("density"))


def complexity(g: Graph) -> DataFrame:
    score = 0.3 * F.col("nodes") + 0.4 * F.col("edges") + 0.2 * F.col("import_nodes") + 0.1 * F.col("function_nodes") / F.greatest(F.col("file_nodes"), F.lit(1))
    return counts(g).select(F.round(score, 3).alias("score"), binned(score, COMPLEXITY, "Low").alias("level"))


def health(g: Graph) -> DataFrame:
    """100 less clamped penalties for density, the criticality of the top three files, and risk."""
    top = file_hotspots(g).orderBy(F.desc("criticality"), "id").limit(3).agg(F.avg("criticality").alias("criticality"))
    one = density(g).crossJoin(top).crossJoin(architecture_risk(g))  # one row each
    score = 100 - clamp(F.col("density") * 40, 0, 30) - clamp(F.coalesce("criticality", F.lit(0.0)) * 20, 0, 20) - clamp(F.col("risk_score") / 2, 0, 30)
    return one.select(F.round(score, 3).alias("health"))


def architecture_risk(g: Graph) -> DataFrame:
    """30, plus files in each module, plus the top file's criticality, plus each risk by severity; at most 100."""
    circle = stored(closed_trails(g).agg(F.when(F.count(F.lit(1)) > 0, 25).otherwise(0).alias("r3")))  # one row; the plan below stays small
    modules = major_modules(g).agg((F.sum("file_count") * 1.0).alias("files"), F.count(F.lit(1)).alias("modules"))
    all_files = g.nodes("File").agg(F.count(F.lit(1)).alias("n_files"))
    top = file_hotspots(g).agg(F.max("criticality").alias("criticality"))
    excess = excess_fan_in(g).agg(F.max("severity").alias("name"), F.max("incoming_degree").alias("most"))
    excess = excess.select(F.when(F.col("most") > 20, 25).when(F.col("most") > 12, 15).when(F.col("most").isNotNull(), 10).otherwise(0).alias("r1"))
    chain = inheritance_chains(g).agg(F.max("depth").alias("d")).select(F.when(F.col("d") > 5, 15).when(F.col("d").isNotNull(), 10).otherwise(0).alias("r2"))
    one = modules.crossJoin(all_files).crossJoin(top).crossJoin(excess).crossJoin(chain).crossJoin(circle)  # one row each
    average = F.col("n_files") / F.col("modules")
    score = 30 + F.when(average > 20, 20).when(average > 10, 10).otherwise(0) + F.when(F.col("criticality") > 0.9, 15).when(F.col("criticality") > 0.7, 8).otherwise(0) + F.col("r1") + F.col("r2") + F.col("r3")
    return one.select(F.least(F.lit(100), score).cast("long").alias("risk_score"))


def onboarding(g: Graph) -> DataFrame:
    """Ordered steps from the top modules, files and functions."""
    top = lambda df, order, name, step: df.orderBy(*order).limit(3).select(F.lit(step).alias("step"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).alias("place"), F.col(name).alias("item"))
    modules = top(major_modules(g), [F.desc("file_count"), "module_name"], "module_name", 1)
    files = top(file_hotspots(g), [F.desc("dependency_count"), "id"], "name", 2)
    functions = top(function_hotspots(g), [F.desc("dependency_count"), "id"], "name", 3)
    last = g.nodes("Repository").select(F.lit(4).alias("step"), F.lit(1).alias("place"), F.lit("tests/").alias("item")).limit(1)
    return modules.unionByName(files).unionByName(functions).unionByName(last)


# How the commonest endings are shown; others in capitals.
LANGUAGES = {"py": "Python", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "java": "Java", "go": "Go"}


def primary_language(g: Graph, ending: str = r"\.([^./]+)$", shown: dict[str, str] = LANGUAGES) -> DataFrame:
    """The language of the most frequent ending of file names, with the files that have it; ties by ending. Files without one count as Unknown only if no file has one."""
    files = g.nodes("File").groupBy(F.lower(F.regexp_extract("rel_path", ending, 1)).alias("ending")).agg(F.count(F.lit(1)).alias("files"))
    top = files.orderBy(F.col("ending") == "", F.desc("files"), "ending").limit(1)
    named = F.create_map(*(F.lit(x) for pair in shown.items() for x in pair))[F.col("ending")]
    return top.select(F.when(F.col("ending") == "", "Unknown").otherwise(F.coalesce(named, F.upper("ending"))).alias("language"), "files")


def summary(g: Graph) -> DataFrame:
    """One row: number of modules and the largest, the file that most depend on, and the risk; what a graph lacks is left out."""
    modules = major_modules(g).agg(F.count(F.lit(1)).alias("n"), F.min_by("module_name", F.struct(-F.col("file_count"), "module_name")).alias("largest"))
    file = file_hotspots(g).agg(F.min_by("name", F.struct(-F.col("dependency_count"), "id")).alias("file"))
    one = modules.crossJoin(file).crossJoin(architecture_risk(g))  # one row each
    risk = binned(F.col("risk_score"), ((80, "critical"), (60, "high"), (40, "moderate")), "low")
    parts = [F.concat("n", F.lit(" modules, "), "largest", F.lit(" the largest")), F.concat(F.substring_index("file", "/", -1), F.lit(" most depended on")),
             F.concat(F.lit("risk "), risk, F.lit(" ("), "risk_score", F.lit(" of 100)"))]
    return one.select(F.concat_ws("; ", *parts).alias("summary"))


def unresolved_parents(g: Graph) -> DataFrame:
    """Inheritance edges whose base class does not exist. Not part of the reference, which drops them silently."""
    return g.edges(INHERITS).join(g.nodes("Class").select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")
