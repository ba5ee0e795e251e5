"""Mixing sources to target weights by weighted fair queueing.

Each source sends its documents in a shuffled order that depends on doc_id
alone, again and again (at most three times). A copy's virtual finish time is
the number of source words up to and with it, divided by the source's target.
Copies are range-sorted by finish time over all sources, and the longest prefix
within the total budget is taken. At that point each source is within about one
document of its target.

Cases: null text has size 0; a null source is a source of its own, sorted last;
sources without words have target 0; documents of size 0 take 0 words; rows
that are repeated (same doc_id and text) queue one after the other; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import running_total
from .storage import as_rows, materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_TIMES = 3


def shares(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> dict[str | None, float]:
    """Targets that share the sum of all sizes by weight; none above most times its source's size.

    Sources in code point order, null last, take the weights in turn. What a capped source leaves
    is shared by weight among the others until none is above its cap.
    """
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, target = float(sum(sizes.values())), list(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > most * sizes[s]]
        if not over:
            target |= {s: unit * weight[s] for s in free}
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free = [s for s in free if s not in target]
    return target


def _finish(copy: Column | int) -> Column:
    return (F.col("source_size") * copy + F.col("before") + F.col("size")) / F.col("target")


def _plan_mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES, seed: int = 7) -> DataFrame:
    """doc_id, text_key, source, size, source_size, target and copies (how often the mix takes the row) for every row.

    The sources' totals and targets (one row for each source) pass through the driver; documents don't.
    """
    spark, text_key = documents.sparkSession, F.xxhash64("text")
    rows = materialize(
        documents.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
                         text_key.alias("text_key"), F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))).alias("turn")),
        "mixing-rows",
    )
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.max("size").alias("longest")).collect()
    target = shares({r["source"]: r["source_size"] for r in totals}, weights, most)
    plan = spark.createDataFrame([(r["source"], r["source_size"], target[r["source"]]) for r in totals], "plan_source string, source_size long, target double")
    budget = sum(target.values())
    # No copy that ends later than this can be in the prefix: up to a virtual time t, each source lacks less than one document.
    latest = 1 + (sum(r["longest"] for r in totals) + 1) / budget if budget else 0.0
    queued = running_total(rows, F.col("source"), [F.col("turn"), F.col("doc_id"), F.col("size"), F.col("text_key")], F.col("size"), "before")
    queued = queued.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    queued = materialize(queued, "mixing-queue")

    def place(copy: Column) -> Column:
        return F.struct(_finish(copy).alias("finish"), F.col("source").alias("source"), copy.cast("int").alias("copy"), F.col("before").alias("before"), F.col("doc_id").alias("doc_id"))

    sent = queued.filter("size > 0 and target > 0").withColumn("copy", F.explode(F.array(*map(F.lit, range(most))))).filter(_finish(F.col("copy")) <= latest)
    sent = sent.select(place(F.col("copy")).alias("place"), "size")
    total = running_total(sent, F.lit("all"), [F.col("place")], F.col("size"), "before")
    cut = total.filter(F.col("before") + F.col("size") <= budget + 1e-6).agg(F.max("place").alias("cut")).head()["cut"]
    last = F.struct(*(F.lit(None if cut is None else cut[f.name]).cast(f.dataType).alias(f.name) for f in sent.schema["place"].dataType))
    copies = sum((F.when(place(F.lit(i)) <= last, 1).otherwise(0) for i in range(most)), F.lit(0))
    sends = (F.col("size") > 0) & (F.col("target") > 0) & F.lit(cut is not None)
    return queued.select("doc_id", "text_key", "source", "size", "source_size", "target", F.when(sends, copies).otherwise(0).alias("copies"))


def mix_sources(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words of all copies that the mix takes) for every row."""
    mixed = _plan_mix(documents, weights, most, seed)
    return mixed.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES, seed: int = 7) -> DataFrame:
    """The rows of documents, each as often as the mix takes it. Of repeated rows (same doc_id, text and source) the copies are summed up first."""
    plan = _plan_mix(documents, weights, most, seed).groupBy("doc_id", "text_key", "source").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    plan = plan.filter("copies > 0").alias("plan")
    # Of equal rows one is taken as often as all of them together.
    own = as_rows(documents, doc_id=F.col("doc_id"), text_key=F.xxhash64("text"), source=F.col("source").cast("string")).alias("own")
    same = [F.col(f"own.{c}").eqNullSafe(F.col(f"plan.{c}")) for c in ("doc_id", "text_key", "source")]
    joined = own.join(plan, same).select("own.*", "plan.copies", "plan.rows")
    repeated = joined.filter("rows > 1").dropDuplicates(["doc_id", "text_key", "source"])
    sent = joined.filter("rows = 1").unionByName(repeated).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return sent.select("row.*")
