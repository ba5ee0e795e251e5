"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize


def _toward_least(pairs: DataFrame, keep: str, own: bool) -> DataFrame:
    """Every u points its neighbours v that pass keep (and, if own, itself) to the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    moved = pairs.join(least, F.col("u") == F.col("w")).filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if own:
        moved = moved.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): for every node that occurs in edges (u, v, same comparable type), the least node that it can reach.

    Nulls and loops are ignored. Each round is written to the shared folder, so lineage stays short; the
    number of rounds grows with the logarithm of the longest path.
    """
    pairs = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "components")
    seen = None
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_least(both, "v > u", own=False)
        pairs = materialize(_toward_least(large, "v <> m", own=True), "components")
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
