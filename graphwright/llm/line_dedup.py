"""Reversible line dedup: exact reference counts of line keys, with sharded cuckoo filters in front.

A line's key is the line with ASCII white space stripped and A-Z lower-cased,
kept as a 128-bit digest. Two tables are the truth: postings (key, doc_id) and
reference counts (key, n_docs, first_doc). A cuckoo filter for each shard of
the key space holds the keys with at least two documents; it supports deletion,
so documents can be taken out again. A filter only spares work: lines that it
lacks are certainly not repeated, and lines that it has are checked against the counts.

Batch use (dedup_lines): counts by a partial aggregation (a line in a third of
all documents is one row for each task), filters of the repeated keys, then the
documents' lines are tested by the filters, and what passes is joined with the
counts. There are as many shards as the repeated keys need, so a filter holds
about SHARD_KEYS keys at any scale. Up to filter_bytes_limit in all the filters are
broadcast; beyond, the lines are shuffled to their shard's filter, a shard with very
many lines in several parts, each with the filter.

Incremental use (LineIndex): insert(docs) and delete(doc_ids) recount only the
keys concerned and correct their filters; the tables are written anew, as a
version of their own, and insert followed by delete restores the index. An index
that was written is opened again by its path.

Cases: null or empty text is one empty line; keys shorter than min_chars code
points are never dropped; rows with the same doc_id count as one document, and
each such row is cut by its own lines; rows with null doc_id keep all their
lines and count nowhere; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import delete_path, fresh_path, list_path, materialize
from .textbatch import mix, pieces

SPACE = b" \t\n\x0b\x0c\r"
SHARDS = 256
SHARD_KEYS = 1 << 17
ROUTED_ROWS = 1 << 20
SLOTS = 4


def line_key(line: bytes, min_chars: int) -> bytes | None:
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a key's two buckets are each other's xor with its fingerprint's hash.

    The table holds only what was inserted, so a deletion is exact for inserted keys. Growth doubles the
    table and inserts again from the keys, which the caller has in the exact counts.
    """

    def __init__(self, buckets: int):
        self.mask = buckets - 1
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint16)

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, len(keys)) / SLOTS / 0.85))))
        while True:
            built = cls(buckets)
            if all(built.insert(k) for k in keys.tolist()):
                return built
            buckets *= 2

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        built = cls(len(data) // (2 * SLOTS))
        built.table = np.frombuffer(data, dtype=np.uint16).reshape(-1, SLOTS).copy()
        return built

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _other(self, bucket: int, print_: int) -> int:
        return (bucket ^ (print_ * 0x5BD1E995)) & self.mask

    @staticmethod
    def _print(key: int) -> int:
        return (key >> 48) or 1

    def insert(self, key: int) -> bool:
        print_, bucket = self._print(key), key & self.mask
        for turn in range(500):
            for b in (bucket, self._other(bucket, print_)):
                row = self.table[b]
                for slot in range(SLOTS):
                    if not row[slot]:
                        row[slot] = print_
                        return True
            bucket = self._other(bucket, print_) if turn % 2 else bucket
            slot = (turn * 7 + print_) % SLOTS
            print_, self.table[bucket, slot] = int(self.table[bucket, slot]), print_
            bucket = self._other(bucket, print_)
        return False

    def delete(self, key: int) -> bool:
        print_ = self._print(key)
        for b in (key & self.mask, self._other(key & self.mask, print_)):
            for slot in range(SLOTS):
                if self.table[b, slot] == print_:
                    self.table[b, slot] = 0
                    return True
        return False

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        prints = np.maximum(keys >> np.uint64(48), np.uint64(1))
        first = keys & np.uint64(self.mask)
        second = (first ^ (prints * np.uint64(0x5BD1E995))) & np.uint64(self.mask)
        wanted = prints.astype(np.uint16)[:, None]
        return ((self.table[first.astype(np.int64)] == wanted) | (self.table[second.astype(np.int64)] == wanted)).any(axis=1)


def _probe(keys: list[bytes], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and 64-bit filter key of each 16-byte line key."""
    raw = np.frombuffer(b"".join(keys), dtype=np.dtype("<u8")).reshape(-1, 2)
    return (raw[:, 0] & np.uint64(shards - 1)).astype(np.int64), mix(raw[:, 1] + np.uint64(1))


def _shard_column(shards: int) -> Column:
    """The shard as _probe computes it, from the key's first three bytes."""
    low = F.concat(*(F.hex(F.substring("key", i, 1)) for i in (3, 2, 1)))
    return F.conv(low, 16, 10).cast("int").bitwiseAND(shards - 1)


def shards_for(keys: int) -> int:
    """A power of two from SHARDS to 2**24, so that a shard has about SHARD_KEYS keys or fewer."""
    return min(1 << 24, max(SHARDS, 1 << max(0, -(-keys // SHARD_KEYS) - 1).bit_length()))


def postings(documents: DataFrame, min_chars: int = 10, filters: Broadcast | None = None, shards: int = SHARDS) -> DataFrame:
    """(key, doc_id), once for each document and distinct key; with filters (cells by shard) only the keys that they may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = None if filters is None else {s: CuckooFilter.load(d) for s, d in filters.value.items()}
        for batch in pieces(batches):
            keys, owners = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if doc_id is not None and text:
                    found = {k for line in text.encode().split(b"\n") if (k := line_key(line, min_chars))}
                    keys += found
                    owners += [doc_id] * len(found)
            made = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(owners, pa.int64())], names=["key", "doc_id"])
            yield made if loaded is None or not keys else made.filter(pa.array(_may_hold(loaded, keys, shards)))

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "key binary, doc_id long")


def _may_hold(filters: dict[int, CuckooFilter], keys: list[bytes], shards: int) -> np.ndarray:
    own, probes = _probe(keys, shards)
    passed = np.zeros(len(keys), dtype=bool)
    for s in np.unique(own).tolist():
        if s in filters:
            at = np.flatnonzero(own == s)
            passed[at] = filters[s].may_have(probes[at])
    return passed


def reference_counts(posted: DataFrame, distinct: bool = False) -> DataFrame:
    """(key, n_docs, first_doc); distinct: postings may hold a (key, doc_id) more than once."""
    rows = posted.groupBy("key", "doc_id").agg(F.lit(1).alias("one")) if distinct else posted
    return rows.groupBy("key").agg(F.count("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def build_filters(repeated: DataFrame, count: int = SHARDS) -> DataFrame:
    """(shard, cells): one cuckoo filter for each shard with keys."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            if batch.num_rows:
                shards, keys = _probe(batch.column(0).to_pylist(), count)
                for s in np.unique(shards).tolist():
                    held.setdefault(s, []).append(keys[shards == s])
        for s, parts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([CuckooFilter.of(np.unique(np.concatenate(parts))).dump()], pa.binary())], names=["shard", "cells"])

    return repeated.select("key").repartition(_shard_column(count)).mapInArrow(build, "shard int, cells binary")


def route_to_filters(posted: DataFrame, repeated: DataFrame, filters: DataFrame, shards: int, part_rows: int = ROUTED_ROWS) -> DataFrame:
    """The postings that their shard's filter may hold, tested where the filter is sent.

    repeated: key and n_docs, from which a shard's rows are known: one with more than part_rows is dealt to several parts.
    """
    loads = repeated.groupBy(_shard_column(shards).alias("shard")).agg(F.ceil(F.sum("n_docs") / part_rows).cast("int").alias("parts"))
    loads = materialize(loads, "line-loads")
    parts = loads.withColumnRenamed("shard", "of")
    held = filters.join(loads, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    held = held.select("shard", "part", "cells", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("doc_id"))
    rows = posted.withColumn("shard", _shard_column(shards)).join(F.broadcast(parts), F.col("shard") == F.col("of"))
    rows = rows.select("shard", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), F.lit(None).cast("binary").alias("cells"), "key", "doc_id")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[int, CuckooFilter] = {}
        for batch in batches:
            # Filters stand before their rows; only the last one seen can have rows in a later batch.
            for i in np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False)).tolist():
                now[batch.column(0)[i].as_py()] = CuckooFilter.load(batch.column(2)[i].as_py())
            asked = batch.filter(batch.column(3).is_valid())
            keys = asked.column(3).to_pylist()
            if keys:
                passed = asked.filter(pa.array(_may_hold(now, keys, shards)))
                yield pa.RecordBatch.from_arrays([passed.column(3), passed.column(4)], names=["key", "doc_id"])
            if batch.num_rows:
                last = batch.column(0)[batch.num_rows - 1].as_py()
                now = {last: now[last]} if last in now else {}

    dealt = held.unionByName(rows).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("cells").isNull())
    return dealt.mapInArrow(test, "key binary, doc_id long")


def dropped_keys(documents: DataFrame, min_chars: int = 10, filter_bytes_limit: int = 32 << 20) -> DataFrame:
    """(doc_id, key): keys whose lines the document loses, because a smaller doc_id holds them as well."""
    counts = reference_counts(postings(documents, min_chars))
    repeated = materialize(counts.filter("first_doc < last_doc").select("key", "n_docs", "first_doc"), "line-counts")
    shards = shards_for(repeated.count())
    filters = materialize(build_filters(repeated, shards), "line-filters")
    size = filters.agg(F.sum(F.octet_length("cells"))).head()[0] or 0
    if size <= filter_bytes_limit:
        held = documents.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["cells"]) for r in filters.toLocalIterator()})
        suspects = postings(documents, min_chars, held, shards)
    else:
        suspects = route_to_filters(postings(documents, min_chars), repeated, filters, shards)
    return suspects.join(repeated, "key").filter("doc_id > first_doc").select("doc_id", "key")


def dedup_lines(documents: DataFrame, min_chars: int = 10, filter_bytes_limit: int = 32 << 20) -> DataFrame:
    """doc_id, text (kept lines), n_lines (before), n_dropped and kept_sha256 for every row."""
    dropped = dropped_keys(documents, min_chars, filter_bytes_limit).groupBy("doc_id").agg(F.array_join(F.collect_set(F.hex("key")), "").alias("gone"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = rows.join(dropped.withColumnRenamed("doc_id", "gone_id"), F.col("doc_id") == F.col("gone_id"), "left").select("doc_id", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts, lines, drops, digests = [], [], [], []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = (text or "").encode()
                split = data.split(b"\n")
                if gone:
                    raw = bytes.fromhex(gone)
                    keys = {raw[i : i + 16] for i in range(0, len(raw), 16)}
                    kept = [line for line in split if line_key(line, min_chars) not in keys]
                    data = b"\n".join(kept)
                    drops.append(len(split) - len(kept))
                else:
                    drops.append(0)
                lines.append(len(split))
                texts.append(data)
                digests.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(drops, pa.int64()), pa.array(digests, pa.string())],
                names=["doc_id", "text", "n_lines", "n_dropped", "kept_sha256"],
            )

    return joined.mapInArrow(run, "doc_id long, text string, n_lines long, n_dropped long, kept_sha256 string")


class LineIndex:
    """An index that documents can be added to and taken from; every state is a set of Parquet tables under path.

    A version counts only if its last table, state (version and number of shards), is there; a path with one is opened again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, min_chars: int = 10):
        self.spark, self.path, self.min_chars, self.version, self.shards = spark, path or fresh_path(spark, "line-index"), min_chars, 0, SHARDS
        done = [int(x[1:]) for x in list_path(spark, self.path) if x[:1] == "v" and x[1:].isdigit() and "_SUCCESS" in list_path(spark, f"{self.path}/{x}/state")]
        if done:
            self.version = max(done)
            self.shards = spark.read.schema("shards int").parquet(self._at("state")).head()["shards"]
        else:
            self._write(spark.createDataFrame([], "key binary, doc_id long"), spark.createDataFrame([], "key binary, n_docs long, first_doc long"), spark.createDataFrame([], "shard int, cells binary"))

    def _at(self, table: str, version: int | None = None) -> str:
        return f"{self.path}/v{self.version if version is None else version}/{table}"

    def _write(self, posted: DataFrame, counts: DataFrame, filters: DataFrame) -> None:
        state = self.spark.createDataFrame([(self.shards,)], "shards int").coalesce(1)
        for table, df in (("postings", posted), ("counts", counts), ("filters", filters), ("state", state)):
            df.write.mode("overwrite").parquet(self._at(table, self.version + 1))
        self.version += 1
        if self.version > 2:
            delete_path(self.spark, f"{self.path}/v{self.version - 2}")

    def postings(self) -> DataFrame:
        return self.spark.read.schema("key binary, doc_id long").parquet(self._at("postings"))

    def counts(self) -> DataFrame:
        return self.spark.read.schema("key binary, n_docs long, first_doc long").parquet(self._at("counts"))

    def filters(self) -> DataFrame:
        return self.spark.read.schema("shard int, cells binary").parquet(self._at("filters"))

    def _update_filters(self, added: DataFrame, removed: DataFrame) -> DataFrame:
        """Per shard: delete the keys that are no longer repeated, insert the new ones, grow where full."""
        shards = self.shards

        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            cells = [c for c in table.column("cells").to_pylist() if c is not None]
            held = CuckooFilter.load(cells[0]) if cells else CuckooFilter(4)
            ops = table.filter(pa.compute.is_valid(table.column("key")))
            keys, signs = ops.column("key").to_pylist(), ops.column("sign").to_pylist()
            if keys:
                probes = _probe(keys, shards)[1].tolist()
                for k, sign in zip(probes, signs):
                    if sign < 0:
                        held.delete(k)
                if not all(held.insert(k) for k, sign in zip(probes, signs) if sign > 0):
                    return pa.table({"shard": [key[0].as_py()], "cells": pa.array([None], pa.binary())}, schema=pa.schema([("shard", pa.int32()), ("cells", pa.binary())]))
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([held.dump()], pa.binary())})

        ops = added.select("key", F.lit(1).alias("sign")).unionByName(removed.select("key", F.lit(-1).alias("sign"))).withColumn("shard", _shard_column(shards)).withColumn("cells", F.lit(None).cast("binary"))
        state = self.filters().withColumn("key", F.lit(None).cast("binary")).withColumn("sign", F.lit(None).cast("int"))
        return ops.unionByName(state).groupBy("shard").applyInArrow(run, "shard int, cells binary")

    def _apply(self, posted: DataFrame, changed: DataFrame) -> None:
        """changed: keys whose postings changed. Their counts are taken anew, and their filters' keys corrected."""
        old = self.counts()
        fresh = materialize(reference_counts(posted.join(changed, "key", "left_semi")).select("key", "n_docs", "first_doc"), "line-fresh")
        counts = old.join(changed, "key", "left_anti").unionByName(fresh)
        was = old.join(changed, "key", "left_semi").filter("n_docs >= 2").select("key")
        now = fresh.filter("n_docs >= 2").select("key")
        wanted = shards_for(counts.filter(F.col("n_docs") >= 2).count())
        if wanted > self.shards:
            self.shards = wanted
            self._write(posted, counts, build_filters(counts.filter(F.col("n_docs") >= 2), wanted))
            return
        filters = materialize(self._update_filters(now.join(was, "key", "left_anti"), was.join(now, "key", "left_anti")), "line-filters")
        if full := [r["shard"] for r in filters.filter("cells is null").collect()]:  # at most one row for each shard
            filters = filters.filter("cells is not null").unionByName(build_filters(counts.filter(F.col("n_docs") >= 2).filter(_shard_column(self.shards).isin(full)), self.shards))
        self._write(posted, counts, filters)

    def insert(self, documents: DataFrame) -> None:
        """Add documents; those whose doc_id is already there are ignored."""
        fresh = documents.join(self.postings().select("doc_id").distinct(), "doc_id", "left_anti")
        new = materialize(postings(fresh, self.min_chars).distinct(), "line-new")
        self._apply(self.postings().unionByName(new), new.select("key").distinct())

    def delete(self, doc_ids: DataFrame) -> None:
        """Take documents out (a frame with doc_id); unknown ones are ignored."""
        gone = materialize(self.postings().join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").select("key").distinct(), "line-gone")
        self._apply(self.postings().join(doc_ids.select("doc_id"), "doc_id", "left_anti"), gone)
