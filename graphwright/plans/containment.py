"""Which texts hold which parts, without comparing every text with every part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of anchors.
LENGTHS = (1, 2, 4, 8, 16, 32, 64)


def contained(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """Distinct (text, part) where part, if not empty, occurs anywhere in text. texts: text; parts: part.

    A part's anchor is its end, in the greatest of LENGTHS that it has. A text that holds the part holds the anchor, so texts are cut into
    grams of the lengths that anchors have, joined by equality, and only what shares an anchor is compared. Ends tell paths apart better than beginnings do.
    """
    length = F.length("part")
    size = F.greatest(*(F.when(length >= n, n) for n in LENGTHS))
    anchors = parts.select("part").filter(length > 0).distinct().select("part", size.alias("size")).withColumn("gram", F.expr("right(part, size)"))
    sizes = [r["size"] for r in anchors.select("size").distinct().collect()]  # at most as many as LENGTHS
    one = texts.select("text").filter("text is not null").distinct()

    def cut_in(n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.length("text") - n + 1), lambda i: F.substring(F.col("text"), i, F.lit(n)))
        return F.when(F.length("text") >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))

    cut = one.select("text", F.explode(F.concat(*map(cut_in, sorted(sizes))) if sizes else F.array().cast("array<string>")).alias("gram"))
    return cut.join(anchors, "gram").filter(F.col("text").contains(F.col("part"))).select("text", "part")
