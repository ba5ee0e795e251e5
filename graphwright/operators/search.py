"""Ranked lexical search over names, paths and modules; case does not matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Graph

#: Label, searched column, score of exact / prefix / inner match, factor, priority.
BRANCHES = [
    ("Function", "name", (1.0, 0.9, 0.7), 1.0, 4),
    ("Class", "name", (1.0, 0.9, 0.7), 0.95, 3),
    ("File", "rel_path", (1.0, 0.85, 0.65), 0.9, 2),
    ("Import", "module", (1.0, 0.8, 0.6), 0.8, 1),
]


def _score(text: Column, query: str, scores: tuple[float, float, float]) -> Column:
    low = F.lower(text)
    return F.when(low == query, scores[0]).when(F.startswith(low, F.lit(query)), scores[1]).when(low.contains(query), scores[2])


def branch(g: Graph, query: str, label: str) -> DataFrame:
    """All matches of one label: id, type, name, score, priority."""
    _, column, scores, factor, priority = next(b for b in BRANCHES if b[0] == label)
    score = _score(F.col(column), query.lower(), scores)
    if label == "Import":  # an imported name that holds the query counts like an inner match
        score = F.coalesce(score, F.when(F.exists(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.lower(n).contains(query.lower())), scores[2]))
    found = g.nodes(label).withColumn("score", F.round(score * factor, 4)).filter("score is not null")
    return found.select("id", F.lower("label").alias("type"), F.col(column).alias("name"), "score", F.lit(priority).alias("priority"))


def search(g: Graph, query: str, limit: int = 50) -> DataFrame:
    """The best matches over all labels: by type priority, then score, name and id."""
    found = branch(g, query, BRANCHES[0][0])
    for label, *_ in BRANCHES[1:]:
        found = found.unionByName(branch(g, query, label))
    return found.orderBy(F.desc("priority"), F.desc("score"), "name", "id").limit(limit).select("id", "type", "name", F.least(F.lit(1.0), "score").alias("score"))


def answer(g: Graph, query: str) -> DataFrame:
    """One row: how many of the listed matches there are, and the first three names."""
    order = F.struct(F.negative("score"), "name", "id")
    return search(g, query).agg(F.count(F.lit(1)).alias("hits"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(order)), 1, 3), lambda x: x["name"]), ", ").alias("top"))
