"""Running totals over sorted data without a single-task window.

Rows are range-partitioned by (group, order) and sorted; each partition adds
up its own rows, and the partitions' totals (one row for each partition and
group that meet: at most partitions + groups rows) give the offsets. They are
broadcast up to BROADCAST_ROWS, else joined by a shuffle on group and
partition. A group that holds a third of all rows is thus spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .storage import materialize

BROADCAST_ROWS = 1_000_000


def _local_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, key, carried = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        names = batch.schema.names
        group = batch.column(names.index("_group")).fill_null("null")
        value = batch.column(names.index("_value")).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = group.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.flatnonzero(coded[1:] != coded[:-1]) + 1))
        before = np.cumsum(value) - value
        base = before[starts].copy()
        if group[0].as_py() == key:
            base[0] -= carried
        before = before - np.repeat(base, np.diff(np.append(starts, n)))
        key, carried = group[n - 1].as_py(), int(before[-1] + value[-1])
        columns = [*batch.columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(before)]
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "_part", "_before"])


def running_total(df: DataFrame, group: Column, order: list[Column], value: Column, out: str) -> DataFrame:
    """df with column out (long): the sum of value over earlier rows of the same group.

    group: any column, compared by its text, null being a group of its own.
    order: decides within a group; rows that agree in all of it stand next to
    each other in an arbitrary order, so it should be total where that matters.
    value: long, not null. An empty df gives an empty result.
    """
    keyed = df.withColumns({
        "_group": F.when(group.isNotNull(), F.concat(F.lit("="), group.cast("string"))),
        "_value": value.cast("long"),
        **{f"_order{i}": c for i, c in enumerate(order)},
    })
    sort = ["_group", *(f"_order{i}" for i in range(len(order)))]
    keyed = keyed.repartitionByRange(*sort).sortWithinPartitions(*sort).drop(*sort[1:])
    schema = T.StructType([*keyed.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_before", T.LongType())])
    placed = materialize(keyed.mapInArrow(_local_totals, schema), "running-total")
    w = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        placed.groupBy("_group", "_part").agg(F.sum("_value").alias("_sum"))
        .select(F.col("_group").alias("_g"), F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_offset")),
        "running-offsets",
    )
    few = offsets.count() <= BROADCAST_ROWS
    joined = placed.join(F.broadcast(offsets) if few else offsets, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn(out, F.col("_before") + F.col("_offset")).drop("_group", "_value", "_part", "_before", "_g", "_p", "_offset")
