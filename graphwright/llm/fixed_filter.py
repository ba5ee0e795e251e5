"""A Bloom filter of fixed size over 64-bit keys, built by Spark tasks and small enough to broadcast at any scale.

Its size is a constant (BITS), so it is a safe broadcast; it is sent compressed, so while it is nearly empty it is smaller still. It never misses a key; with more keys it only lets
more strangers pass, which costs work in later exact steps but never changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .textbatch import mix

BITS = 1 << 28
CHUNK = 1 << 20
HASHES = 2


def _bits(keys: np.ndarray, turn: int) -> np.ndarray:
    return (mix(keys + np.uint64(0x632BE59BD9B4E019 * (turn + 1) % (1 << 64))) % np.uint64(BITS)).astype(np.int64)


def build(keys: DataFrame) -> Broadcast:
    """Broadcast bytes for the long keys in the first column of keys (nulls are ignored)."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)
            found = np.unique(np.concatenate([_bits(values, k) for k in range(HASHES)]))
            yield pa.RecordBatch.from_arrays([pa.array((found // CHUNK).astype(np.int32)), pa.array((found % CHUNK).astype(np.int32))], names=["chunk", "bit"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            chunks, places = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for chunk in np.unique(chunks).tolist():
                own = places[chunks == chunk]
                np.bitwise_or.at(held.setdefault(chunk, np.zeros(CHUNK // 8, dtype=np.uint8)), own >> 3, np.left_shift(1, own & 7).astype(np.uint8))
        for chunk, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["chunk", "cells"])

    cells = np.zeros(BITS // 8, dtype=np.uint8)
    packed = keys.mapInArrow(bits, "chunk int, bit int").repartition("chunk").mapInArrow(pack, "chunk int, cells binary")
    for row in packed.toLocalIterator():  # at most BITS / CHUNK rows
        cells[row["chunk"] * CHUNK // 8 : (row["chunk"] + 1) * CHUNK // 8] = np.frombuffer(bytes(row["cells"]), dtype=np.uint8)
    return keys.sparkSession.sparkContext.broadcast(zstandard.ZstdCompressor(level=1).compress(cells.tobytes()))


def load(cells: Broadcast) -> np.ndarray:
    """The filter's bytes, once for each task."""
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(cells.value, max_output_size=BITS // 8), dtype=np.uint8)


def may_have(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), dtype=bool)
    for k in range(HASHES):
        bit = _bits(keys, k)
        found &= (table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
    return found


def select(batches: Iterator[pa.RecordBatch], at: int, cells: Broadcast | None, inside: bool) -> Iterator[pa.RecordBatch]:
    """The rows whose long key in column at may be in the filter (or certainly is not); null keys are outside. Without a filter all rows."""
    table = None if cells is None else load(cells)
    for batch in batches:
        if table is not None:
            column = batch.column(at)
            keys = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            batch = batch.filter(pa.array((may_have(table, keys) & column.is_valid().to_numpy(zero_copy_only=False)) == inside))
        yield batch


def suspects(df: DataFrame, key: str, cells: Broadcast) -> DataFrame:
    """The rows of df whose long column key may be in the filter."""
    at = df.columns.index(key)
    return df.mapInArrow(lambda batches: select(batches, at, cells, True), df.schema)
