"""Symbols of source files: functions, classes, imports, inheritance and calls, one row each.

kind, name, line, params, decorators, bases, methods, module, import_type, names, with path, rel_path and language.

Python files are read by the standard library's syntax tree in a small function, JavaScript, TypeScript and Java by Spark expressions over whole texts (`braces`).
"""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import braces

FIELDS = "kind string, name string, line int, params array<string>, decorators array<string>, bases array<string>, methods array<string>, module string, import_type string, names array<string>"
WHERE = ("path", "rel_path", "language")


def _row(kind: str, name: str | None, line: int, **more) -> dict:
    return {"kind": kind, "name": name, "line": line, **{k: more.get(k) for k in ("params", "decorators", "bases", "methods", "module", "import_type", "names")}}


def _dotted(node: ast.expr) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (base := _dotted(node.value)):
        return f"{base}.{node.attr}"
    return _dotted(node.func) if isinstance(node, ast.Call) else None


def python_symbols(text: str) -> list[dict]:
    """Functions (at any depth, decorated ones too), classes, imports, calls of plain names with a lower-case initial (first one each)."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [_row("error", str(e)[:200], getattr(e, "lineno", None) or 0)]
    found, called = [], set()
    for node in ast.walk(tree):  # level by level, so deep trees need no deep stack
        line = getattr(node, "lineno", 0)
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            a = node.args
            found.append(_row("function", node.name, line, params=[x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs)], decorators=[d for d in map(_dotted, node.decorator_list) if d]))
        elif isinstance(node, ast.ClassDef):
            bases = [b for b in map(_dotted, node.bases) if b]
            found.append(_row("class", node.name, line, bases=bases, methods=[x.name for x in node.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]))
            if bases:
                found.append(_row("inheritance", node.name, line, bases=bases))
        elif isinstance(node, ast.Import):
            found += [_row("import", None, line, module=x.name, import_type="import", names=[x.asname] if x.asname else []) for x in node.names]
        elif isinstance(node, ast.ImportFrom):
            found.append(_row("import", None, line, module="." * node.level + (node.module or ""), import_type="from", names=[x.name for x in node.names]))
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.func.id[:1].isupper() and node.func.id not in called:
            called.add(node.func.id)
            found.append(_row("call", node.func.id, line))
    return sorted(found, key=lambda r: (r["line"], r["kind"]))


def _from_python(files: DataFrame) -> DataFrame:
    parse = F.udf(python_symbols, f"array<struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>>", useArrow=True)
    return files.filter("language = 'python' and text is not null").select(*WHERE, F.explode(parse("text")).alias("s")).select(*WHERE, "s.*")


def _symbol(df: DataFrame, kind: Column, **values: Column) -> DataFrame:
    kinds = dict(f.split(" ") for f in FIELDS.split(", "))
    values |= {"kind": kind, "line": F.col("line")}
    return df.select(*WHERE, *(values.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()))


def _from_braces(files: DataFrame, language: str) -> DataFrame:
    """Scripts (JavaScript, TypeScript) or Java; of functions and calls that count once, the first."""
    own = F.col("language").isin("java") if language == "java" else F.col("language").isin("javascript", "typescript", "tsx")
    rows = braces.symbols(files.filter(own & F.col("text").isNotNull()), language)
    again = F.row_number().over(Window.partitionBy("path", "kind", "once").orderBy("line"))
    rows = rows.withColumn("n", F.when(F.col("once").isNotNull(), again).otherwise(1)).filter("n = 1")
    given = {c: F.col(c) for c in ("params", "bases", "methods", "module", "names", "name")}
    return _symbol(rows, F.col("kind"), **given, decorators=F.when(F.col("kind") == "function", F.array().cast("array<string>")), import_type=F.when(F.col("kind") == "import", "import"))


def extract(files: DataFrame) -> DataFrame:
    """All symbols of files (with_text). Of imports with the same type, module and file the first stays. Unreadable files are error rows."""
    found = _from_python(files).unionByName(_from_braces(files, "script")).unionByName(_from_braces(files, "java"))
    first = Window.partitionBy("path", "kind", "import_type", "module").orderBy("line")
    imports = found.filter("kind = 'import'").withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    errors = _symbol(files.filter("error is not null").withColumn("line", F.lit(0)), F.lit("error"), name=F.col("error"))
    return found.filter("kind <> 'import'").unionByName(imports).unionByName(errors)


def summary(symbols: DataFrame) -> DataFrame:
    """One row: how many of each kind, parsed files and files with errors."""
    kinds = [F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("function", "class", "import", "inheritance", "call", "error")]
    return symbols.agg(*kinds, F.count_distinct(F.when(F.col("kind") != "error", F.col("path"))).alias("parsed_files"))
