"""SimHash near-duplicates with BK-trees.

Fingerprints: the majority of each bit over XXH64 hashes of word shingles. Two fingerprints that
differ in at most `radius` bits agree in one of radius + 1 bands of bits, so each band value is a shard with
a BK-tree of its own (children keyed by the Hamming distance to the parent; a search follows the edges from
d - radius to d + radius). Trees are numpy arrays, built and searched level by level for all shards of a task
at once. Trees are not broadcast, as together they grow with the corpus: a shard's tree is sent to the task that has
its queries. A shard with more than TREE_SIZE fingerprints is divided again by the
same rule over the bits that it leaves free, so ten thousand million fingerprints still stand in small shards, four copies more of each. Where
fingerprints are so much alike that this does not part them, a shard is cut into pieces, and each pair of pieces is a search of its own,
so no task holds more than two pieces. A shard emits a spanning forest of its links, not all pairs; components follow
from these by large-star / small-star rounds.

Only distinct fingerprints are searched, so a group of exact copies is one entry, however large.

Cases: null, empty and blank texts have fingerprint 0 and are linked like any other; fewer words than a
shingle are one shingle; repeated rows share a component; a component whose rows all lack a doc_id has a null id;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import materialize
from .textbatch import BLOCK, Words, majority_bits, pieces

SEED = 42
TREE_SIZE = 4096
_BATCH = 100_000
_QUERIES = 4096
_SALTS = 32


def _shingle_hashes(found: Words, begin: int, end: int, words: int) -> np.ndarray:
    """Hashes of the shingles of words begin to end - 1, the words of one text (at least one). Words are joined in blocks."""
    digest, n = xxhash.xxh64_intdigest, max(end - begin - words + 1, 1)
    out = np.empty(n, dtype=np.uint64)
    for at in range(0, n, BLOCK):
        count = min(BLOCK, n - at)
        stop = min(begin + at + count + words - 1, end)
        joined = found.joined(begin + at, stop)
        upto = np.cumsum(found.ends[begin + at : stop] - found.starts[begin + at : stop] + 1)
        starts, ends = np.append(0, upto)[:count], upto[-count:] - 1
        out[at : at + count] = [digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist())]
    return out


def simhashes(texts: pa.Array, words: int) -> np.ndarray:
    found = Words(texts, lower=True)
    out = np.zeros(len(texts), dtype=np.uint64)
    full = np.flatnonzero(found.counts)
    if len(full):
        hashes = [_shingle_hashes(found, begin, end, words) for begin, end in zip(found.docs[full].tolist(), found.docs[full + 1].tolist())]
        sizes = np.array([len(own) for own in hashes])
        out[full] = majority_bits(np.concatenate(hashes), np.cumsum(sizes) - sizes)
    return out


def fingerprints(documents: DataFrame, words: int = 3) -> DataFrame:
    """doc_id (long) and fp (long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(simhashes(piece.column(1), words).view(np.int64))], names=["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


class BKForest:
    """BK-trees of many groups; members of a group stand together and have different codes."""

    def __init__(self, codes: np.ndarray, groups: np.ndarray):
        self.codes = codes
        first = np.concatenate(([True], groups[1:] != groups[:-1])) if len(groups) else np.zeros(0, dtype=bool)
        self.roots = np.flatnonzero(first)
        self.root_groups = groups[self.roots]
        keys, children = [], []
        rest = np.flatnonzero(~first)
        above = self.roots[np.cumsum(first) - 1][rest] if len(rest) else rest
        while len(rest):
            key = above * 65 + np.bitwise_count(codes[rest] ^ codes[above])
            order = np.argsort(key, kind="stable")
            key, rest = key[order], rest[order]
            first = np.concatenate(([True], key[1:] != key[:-1]))
            keys.append(key[first])
            children.append(rest[first])
            above = rest[first][np.cumsum(first) - 1][~first]
            rest = rest[~first]
        self.keys = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
        order = np.argsort(self.keys)
        self.keys, self.children = self.keys[order], (np.concatenate(children) if children else np.zeros(0, dtype=np.int64))[order]

    def search(self, codes: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) pairs within radius, each query in its own group's tree only."""
        at = np.searchsorted(self.root_groups, groups)
        at = np.minimum(at, max(0, len(self.roots) - 1))
        own = np.flatnonzero(self.root_groups[at] == groups) if len(self.roots) else np.zeros(0, dtype=np.int64)
        query, node = own, self.roots[at[own]] if len(own) else own
        queries, members = [], []
        while len(query):
            apart = np.bitwise_count(codes[query] ^ self.codes[node]).astype(np.int64)
            near = apart <= radius
            queries.append(query[near])
            members.append(node[near])
            if not len(self.keys):
                break
            next_query, next_node = [], []
            for step in range(-radius, radius + 1):
                key = node * 65 + apart + step
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = (self.keys[place] == key) & (apart + step > 0)
                next_query.append(query[found])
                next_node.append(self.children[place[found]])
            query, node = np.concatenate(next_query), np.concatenate(next_node)
        if not queries:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(queries), np.concatenate(members)


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; label points every member to the least one of its set, before and after."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label != (shorter := label[label])).any():
            label[:] = shorter


def _forest_links(codes: np.ndarray, groups: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between members of a group. Side 0 is in the tree; if a group has side 1, that alone queries, else side 0 does."""
    in_tree = np.flatnonzero(side == 0)
    forest = BKForest(codes[in_tree], groups[in_tree])
    crossed = np.unique(groups[side == 1])
    asks = np.flatnonzero((side == 1) | ~np.isin(groups, crossed))
    label = np.arange(len(codes))
    for i in range(0, len(asks), _QUERIES):
        own = asks[i : i + _QUERIES]
        q, m = forest.search(codes[own], groups[own], radius)
        _unite(label, own[q], in_tree[m])
    linked = np.flatnonzero(label != np.arange(len(label)))
    return codes[linked], codes[label[linked]]


def _search_tasks(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def links(rows: np.ndarray) -> pa.RecordBatch:
            group = np.cumsum(np.concatenate(([0], (np.diff(rows[:, :3], axis=0) != 0).any(axis=1)))) if len(rows) else np.zeros(0, dtype=np.int64)
            a, b = _forest_links(rows[:, 4].copy().view(np.uint64), group, rows[:, 3], radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
            count += batch.num_rows
            if count >= _BATCH:
                rows = np.concatenate(held)
                last = np.flatnonzero((rows[:, :3] == rows[-1, :3]).all(axis=1))[0]
                if last:
                    yield links(rows[:last])
                held, count = [rows[last:]], len(rows) - last
        if count:
            yield links(np.concatenate(held))

    return run


def _cut_out(bits: Column, low: int, high: int) -> Column:
    return F.shiftrightunsigned(bits, low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def _bands(bits: Column, width: int, bands: int) -> list[Column]:
    """The lowest width bits as bands: numbers that hold the band's index and its bits."""
    edges = [width * b // bands for b in range(bands + 1)]
    return [F.lit(b << 32) + _cut_out(bits, edges[b], edges[b + 1]) for b in range(bands)]


def _divided(shards: DataFrame, bands: int) -> DataFrame:
    """(shard, sub, fp): each fingerprint once for each band of the bits that its shard does not fix."""

    def free(b: int) -> list[Column]:
        low, high = 64 * b // bands, 64 * (b + 1) // bands
        rest = _cut_out(F.col("fp"), 0, low) if low else F.lit(0).cast("long")
        above = F.shiftleft(F.shiftrightunsigned(F.col("fp"), high), low) if high < 64 else F.lit(0).cast("long")
        return _bands(rest.bitwiseOR(above), 64 - (high - low), bands)

    chosen = F.coalesce(*(F.when(F.shiftright("shard", 32) == b, F.array(*free(b))) for b in range(bands)))
    return shards.select("shard", F.explode(chosen).alias("sub"), "fp")


def link_fingerprints(prints: DataFrame, radius: int = 3, tree_size: int = TREE_SIZE) -> DataFrame:
    """(u, v): links that connect all fingerprints (column fp, distinct) within radius of each other, each shard by a spanning forest.

    The table of shards above tree_size, which is broadcast, has at most (radius + 1) * 2**(64 / (radius + 1)) rows; that of
    divided shards is not bounded so and is joined.
    """
    bands = radius + 1
    shards = prints.select(F.explode(F.array(*_bands(F.col("fp"), 64, bands))).alias("shard"), "fp")
    shards = materialize(shards, "simhash-shards")
    large = F.broadcast(materialize(shards.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tree_size).select("shard"), "simhash-large"))
    whole = shards.join(large, "shard", "left_anti").select("shard", F.lit(-1).cast("long").alias("sub"), F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("side"), "fp")
    parted = materialize(_divided(shards.join(large, "shard", "left_semi"), bands), "simhash-parted")
    sizes = parted.groupBy("shard", "sub").agg(F.count(F.lit(1)).alias("n")).select("shard", "sub", F.ceil(F.col("n") / tree_size).cast("int").alias("cuts"))
    cut = parted.join(sizes.filter("cuts > 1"), ["shard", "sub"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    cells = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    cells = cells.select("shard", "sub", (F.least("own", "other") * F.lit(1 << 31) + F.greatest("own", "other")).alias("cell"), (F.col("own") > F.col("other")).cast("long").alias("side"), "fp")
    place = ["shard", "sub", "cell"]
    sorted_ = whole.unionByName(cells).repartition(*place).sortWithinPartitions(*place, "side")
    return sorted_.mapInArrow(_search_tasks(radius), "u long, v long")


def near_duplicates(documents: DataFrame, words: int = 3, radius: int = 3, tree_size: int = TREE_SIZE) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id for every row."""
    rows = materialize(fingerprints(documents, words), "simhash-rows")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(link_fingerprints(prints.select("fp"), radius, tree_size))
    placed = materialize(prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", "root"), "simhash-placed")
    linked = placed.filter("root is not null")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # One component may hold a third of all fingerprints: its row is repeated, and its members are dealt among the repeats.
    dealt = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    named = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(_SALTS)).cast("int")).join(dealt, ["root", "salt"]).select(F.col("fp").alias("print"), "component_id")
    named = named.unionByName(placed.filter("root is null").select(F.col("fp").alias("print"), F.col("first_id").alias("component_id")))
    joined = rows.join(named, F.col("fp") == F.col("print"))
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
