"""What each filter of a chain takes, in every order, and what it is due: Shapley values from the Hart-Mas-Colell potential.

A document's failed filters are a bit mask, so a part of the corpus is described by its counts for each mask. The removal game gives a
coalition S of filters the documents that at least one of S removes, v(S). Its potential is zero for nobody and
    P(S) = (v(S) + sum of P(S without i) over i in S) / |S|,
computed over the coalitions from small to large; filter i is due P(all) - P(all without i). With k filters Q(S) = |S|! P(S) stays a whole
number, Q(S) = (|S| - 1)! v(S) + sum of Q(S without i), and k! times the value, which is the filter's removals summed over all orders, is
Q(all) - k Q(all without i). Differences of v along an order give its steps.

Texts are digested once; only doc_id, digest, part and mask are shuffled: to find each text's smallest doc_id (partial aggregates first, so a
text that a third of all rows hold is no hot key), to mark those documents, and to fetch labels, both by doc_id.

Cases: null text is an empty one, a null part an empty string; a null doc_id is never smaller than another, so such a row
neither fails nor causes the filter of repeated texts, and has no label; of several labels of a document each mark counts once;
repeated rows count each (equal doc_ids are not smaller than each other); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
MOST_FILTERS = 6


def word_filters(text: Column) -> dict[str, Column]:
    """Conditions that a text fails: few words, few different words, capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": F.regexp_like(text, F.lit("[#$%&*|]")),
    }


def fail_masks(documents: DataFrame, filters: dict[str, Column], part: Column, repeated: str | None = None) -> DataFrame:
    """(doc_id, part, mask) of every row: bit k is set if the row fails the k-th filter. repeated names one more filter, the last bit: the text is that of a smaller doc_id.

    filters are conditions over a column text, which is never null.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(filters.values())), F.lit(0))
    if repeated is None:
        return rows.select("doc_id", "part", bits.cast("int").alias("mask"))
    marked = materialize(rows.select("doc_id", "part", bits.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "audit-masks")
    first = marked.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    # Joined by doc_id: the copies of a text, however many, meet nothing there. A null first_id (no ids at all) stays out.
    joined = marked.join(first.filter("first_id is not null").withColumnRenamed("digest", "own"), (F.col("doc_id") == F.col("first_id")) & (F.col("digest") == F.col("own")), "left")
    again = F.when(F.col("doc_id").isNotNull() & F.col("first_id").isNull(), 1 << len(filters)).otherwise(0)
    return joined.select("doc_id", "part", F.col("mask").bitwiseOR(again).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows for each mask, those labelled of good quality and those labelled toxic."""
    mark = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), "quality", "toxic").filter("label_id is not null").groupBy("label_id").agg(mark("quality"), mark("toxic"))
    joined = masks.join(known, F.col("doc_id") == F.col("label_id"), "left")
    n = lambda c: F.count_if(F.coalesce(F.col(c) == 1, F.lit(False)))
    return joined.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), n("quality").alias("good"), n("toxic").alias("toxic"))


def _coalitions(counts: DataFrame, k: int) -> DataFrame:
    """One row for each part: the sizes of all coalitions' removals (index: their mask) of all rows, good ones and toxic ones, and the number of rows."""
    hit = lambda s: F.col("mask").bitwiseAND(F.lit(s)) != 0
    sums = lambda c: F.array(*(F.coalesce(F.sum(F.when(hit(s), F.col(c))), F.lit(0)).cast("long") for s in range(1 << k))).alias(f"v_{c}")
    return counts.groupBy("part").agg(sums("n"), sums("good"), sums("toxic"), F.sum("n").alias("rows"))


def with_potentials(parts: DataFrame, v: str, k: int) -> DataFrame:
    """parts with q: the array of Q(S) = |S|! P(S) for the coalitions S of k players by size, then mask (see place()); v names the array of their worth."""
    at = place(k)
    out = parts.withColumn("q", F.array(F.lit(0).cast("long")))
    for size in range(1, k + 1):
        # The coalitions one player smaller are all in the array by now.
        level = [F.get(v, F.lit(s)) * math.factorial(size - 1) + sum((F.get("q", F.lit(at[s ^ (1 << i)])) for i in range(k) if s >> i & 1), F.lit(0).cast("long")) for s in at if s.bit_count() == size]
        out = out.withColumn("q", F.concat("q", F.array(*level)))
    return out


def place(k: int) -> dict[int, int]:
    """Where the array of potentials has each coalition."""
    return {s: i for i, s in enumerate(sorted(range(1 << k), key=lambda s: (s.bit_count(), s)))}


def audit(counts: DataFrame, names: str) -> DataFrame:
    """One row for each part, order of the filters (letters of names, bit k is the k-th) and step.

    kept, removed, redundant (fails its filter, removed earlier), unique_fails (fails its filter alone), good_lost, toxic_lost, and
    shapley (the filter's removals summed over all orders).
    """
    k = len(names)
    if not 0 < k <= MOST_FILTERS:
        raise ValueError(f"{k} filters: 1 to {MOST_FILTERS} have all their orders listed")
    parts, at = with_potentials(_coalitions(counts, k), "v_n", k), place(k)
    orders = F.split(F.lit(",".join("".join(p) for p in itertools.permutations(names))), ",")
    rows = parts.select("*", F.explode(orders).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    bit = lambda letter: F.expr(f"cast(shiftleft(1, instr('{names}', {letter}) - 1) as int)")
    before = F.expr(f"aggregate(sequence(1, {k}), 0, (s, i) -> s + if(i < step, cast(shiftleft(1, instr('{names}', substr(filter_order, i, 1)) - 1) as int), 0))")
    rows = rows.withColumns({"own": bit("substr(filter_order, step, 1)"), "earlier": before}).withColumn("upto", F.col("earlier") + F.col("own"))
    everyone = (1 << k) - 1
    rest = F.lit(everyone) - F.col("own")
    without = F.create_map(*(F.lit(x) for i in range(k) for x in (1 << i, at[everyone ^ (1 << i)])))[F.col("own")]
    of = lambda v, s: F.get(F.col(v), s)
    gone = lambda v: of(v, F.col("upto")) - of(v, F.col("earlier"))
    return rows.select(
        "part", "filter_order", "step", (F.col("rows") - of("v_n", F.col("upto"))).alias("kept"), gone("v_n").alias("removed"), (of("v_n", F.col("own")) - gone("v_n")).alias("redundant"),
        (of("v_n", F.lit(everyone)) - of("v_n", rest)).alias("unique_fails"), gone("v_good").alias("good_lost"), gone("v_toxic").alias("toxic_lost"), (of("q", F.lit(at[everyone])) - k * of("q", without)).alias("shapley"),
    )


def audit_sources(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters A to E over documents, for each source."""
    masks = fail_masks(documents, word_filters(F.col("text")), F.col("source"), repeated="E")
    return audit(mask_counts(masks, labels), "ABCDE")
