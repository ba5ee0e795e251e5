"""From symbols to a Graph: identities, containment, and resolution of names across files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import CALLS, CONTAINS_CLASS, CONTAINS_FILE, CONTAINS_FUNCTION, IMPORTS, INHERITS, Graph
from ..plans.containment import contained


def node_id(kind: str, analysis: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), F.lit(analysis), *parts)


def build(files: DataFrame, symbols: DataFrame, analysis: str, repository: str, compat: bool = False) -> Graph:
    """files: path, rel_path; symbols: sources.symbols.extract. Rows with equal identity collapse; the last by line wins. compat: callers as resolve_calls_compat finds them."""
    of = lambda kind: symbols.filter(F.col("kind") == kind)
    path = F.col("rel_path")
    file_id = node_id("file", analysis, path)
    one = lambda df, *keep: df.groupBy("id").agg(*(F.max_by(c, "line").alias(c) for c in keep), F.max("line").alias("line_number"))
    functions = one(of("function").select(node_id("func", analysis, path, F.col("name")).alias("id"), "name", file_id.alias("file_id"), "params", "decorators", "line"), "name", "file_id", "params", "decorators")
    classes = one(of("class").select(node_id("class", analysis, path, F.col("name")).alias("id"), "name", file_id.alias("file_id"), F.size("methods").cast("long").alias("methods_count"), "bases", "methods", "line"), "name", "file_id", "methods_count", "bases", "methods")
    imports = one(of("import").select(node_id("import", analysis, path, F.col("module")).alias("id"), "module", file_id.alias("file_id"), "names", "import_type", "line"), "module", "file_id", "names", "import_type")
    counts = symbols.groupBy("rel_path").agg(*(F.count_if(F.col("kind") == k).alias(c) for k, c in (("function", "functions_count"), ("class", "classes_count"), ("import", "imports_count"))))
    file_nodes = files.select("rel_path").distinct().join(counts, "rel_path", "left").select(
        file_id.alias("id"), F.element_at(F.split(path, "/"), -1).alias("name"), "rel_path", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("functions_count", "classes_count", "imports_count")))
    repo = files.select(F.lit(f"repo:{analysis}").alias("id"), F.lit(repository).alias("name")).limit(1)
    paths = functions.select("id", "name", F.substring("file_id", len(f"file:{analysis}:") + 1, 1 << 20).alias("path"))
    calls = resolve_calls_compat(of("call").select(path.alias("path"), "name"), paths) if compat else resolve_calls(of("call").select(file_id.alias("file_id"), "name"), functions)
    contains = lambda nodes: nodes.select(F.col("file_id").alias("src"), F.col("id").alias("dst"))
    return Graph(
        {"Repository": lambda: repo, "File": lambda: file_nodes, "Function": lambda: functions, "Class": lambda: classes, "Import": lambda: imports},
        {
            CONTAINS_FILE: lambda: file_nodes.select(F.lit(f"repo:{analysis}").alias("src"), F.col("id").alias("dst")),
            CONTAINS_FUNCTION: lambda: contains(functions), CONTAINS_CLASS: lambda: contains(classes), IMPORTS: lambda: contains(imports),
            INHERITS: lambda: resolve_inheritance(of("inheritance"), classes), CALLS: lambda: calls,
        },
    )


def resolve_inheritance(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Child and base by name over all files; of several classes with a name the least id. Unknown bases fall away."""
    first = classes.groupBy("name").agg(F.min("id").alias("id"))
    pairs = rows.select(F.col("name").alias("child"), F.explode("bases").alias("base"))
    child, base = first.select(F.col("name").alias("child"), F.col("id").alias("src")), first.select(F.col("name").alias("base"), F.col("id").alias("dst"))
    return pairs.join(child, "child").join(base, "base").select("src", "dst").distinct()


def resolve_calls(rows: DataFrame, functions: DataFrame) -> DataFrame:
    """Every function of the calling file to every function with the called name, but not to itself.

    File and name are made distinct before the join, as its size is the product of both sides' fan-outs.
    """
    callees = rows.select("file_id", "name").distinct().join(functions.select("name", F.col("id").alias("dst")), "name")
    return callees.join(functions.select("file_id", F.col("id").alias("src")), "file_id").filter("src <> dst").select("src", "dst").distinct()


def resolve_calls_compat(rows: DataFrame, functions: DataFrame) -> DataFrame:
    """As resolve_calls, but the callers are all functions whose path:name holds the calling file's path, so that x.ts calls for x.tsx too.

    rows: path, name; functions: id, name, path. Found by anchors (plans.containment), so no pair of file and function is compared in vain.
    """
    callees = rows.filter("path <> ''").select("path", "name").distinct().join(functions.select("name", F.col("id").alias("dst")), "name")
    keys = functions.select(F.concat_ws(":", "path", "name").alias("text"), F.col("id").alias("src"))
    callers = contained(keys, callees.select(F.col("path").alias("part"))).join(keys, "text").select(F.col("part").alias("path"), "src")
    return callees.join(callers, "path").filter("src <> dst").select("src", "dst").distinct()


def edge_diagnostics(raw: DataFrame) -> DataFrame:
    """One row: edges before and after duplicates are removed. raw: src, dst, rel_type."""
    n = raw.groupBy("src", "dst", "rel_type").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("unique_edges"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed"))
