"""Sharding by longest processing time: whole groups, largest first, each to the least-loaded shard.

Spark computes group sizes and their histogram over size classes; the heap runs over that histogram only. Sizes below 2**14 bytes
are a class each; larger ones share a class with those that agree in their first 14 bits, so no class is wider than 1/8192 of its
sizes and there are at most 2**14 + 2**13 classes for each doubling beyond (some 230,000 for groups up to a terabyte), however
many documents there are. A class is dealt at its mean size, the groups of a class by their rank in the order of their digests;
each class gets a quota for every shard.

A group is never divided: equal texts share a shard even if a group is larger
than a fair share. Loads then differ from the mean by at most the largest group, and from the plain heap's by at most 1/8192 of
what a shard holds of classes of several sizes.

Cases: null text counts as an empty text (size 8) and is grouped with empty
ones; rows with equal text and doc_id each get a slot; null doc_ids sort
first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import running_total
from .storage import materialize

#: Sizes are told apart by so many leading bits.
EXACT_BITS = 14


def _level(loads: list[int], size: int, count: int) -> int:
    """The largest level up to which all shards can be filled with at most count groups of this size."""
    low, high = min(loads), max(loads) + size * (count + 1)
    while low < high:
        middle = (low + high + 1) // 2
        if sum(max(0, -((x - middle) // size)) for x in loads) <= count:
            low = middle
        else:
            high = middle - 1
    return low


def lpt_quotas(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int], list[int]]]:
    """For every (size, count), largest size first: shard numbers and, for each, the rank after its last group.

    The same loads as giving the groups one by one to the least-loaded shard (the
    lowest number of equal ones), but a size with very many groups is filled level by level.
    """
    loads, heap, quotas = [0] * shards, [(0, k) for k in range(shards)], []
    for size, count in sorted(histogram, reverse=True):
        given: dict[int, int] = {}
        if count > 4 * shards and size > 0:
            level = _level(loads, size, count)
            for k, load in enumerate(loads):
                if (n := max(0, -((load - level) // size))) > 0:
                    given[k] = n
                    loads[k] += n * size
                    count -= n
            heap = [(load, k) for k, load in enumerate(loads)]
            heapq.heapify(heap)
        for _ in range(count):
            load, k = heap[0]
            heapq.heapreplace(heap, (load + size, k))
            loads[k] = load + size
            given[k] = given.get(k, 0) + 1
        order = sorted(given)
        bounds, total = [], 0
        for k in order:
            total += given[k]
            bounds.append(total)
        quotas.append((size, order, bounds))
    return quotas


def shard_documents(documents: DataFrame, shards: int = 24, overhead: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot and grown_shard (null) for every row."""
    spark = documents.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(
        documents.select(
            "doc_id",
            (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
        ),
        "sharding-rows",
    )
    spare = F.greatest(F.length(F.bin("group_size")) - EXACT_BITS, F.lit(0))
    groups = rows.groupBy("digest").agg(F.sum("size").alias("group_size")).withColumn("spare", spare)
    groups = groups.withColumn("size_class", F.expr("shiftleft(shiftright(group_size, spare), spare)")).drop("spare")
    ranked = materialize(running_total(groups, F.col("size_class"), [F.col("digest")], F.lit(1), "rank"), "sharding-groups")
    classes = ranked.groupBy("size_class").agg(F.count(F.lit(1)).alias("n"), F.sum("group_size").alias("bytes")).toLocalIterator()
    # The mean, rounded down, lies in its class, so no two classes share one.
    histogram = {r["bytes"] // r["n"]: r for r in classes}
    planned = lpt_quotas([(mean, r["n"]) for mean, r in histogram.items()], shards)
    quotas = spark.createDataFrame([(histogram[mean]["size_class"], order, bounds) for mean, order, bounds in planned], "size_class long, shards array<int>, bounds array<long>")
    # As many rows as classes, so small enough to broadcast.
    placed = ranked.join(F.broadcast(quotas), "size_class").select(
        "digest",
        F.element_at("shards", F.size(F.filter("bounds", lambda b: b <= F.col("rank"))) + 1).alias("shard"),
    )
    dealt = rows.join(placed, "digest").select("doc_id", "size", "text_crc32", "shard", "digest")
    slotted = running_total(dealt, F.col("shard"), [F.col("doc_id"), F.col("digest")], F.lit(1), "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
