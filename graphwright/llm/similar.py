"""Near-duplicates by shingle similarity: BK-trees of SimHash codes in shards of MinHash bands.

Two bits of SimHash distance more or less say little about texts that are 80 % alike (their codes differ by 5 to 17 bits),
so the exact radius-3 search of simhash_bk misses most of them. Here shards come from MinHash bands: texts with
Jaccard similarity s of their word shingles share one of 16 bands of 4 values with probability 1 - (1 - s^4)^16 (0.9998 at
0.8). In a shard, the BK-tree over SimHash codes is searched within a wide radius, which only orders the pairs: those beyond it
are compared after those within. Of a pair of which at least `similarity` - MARGIN of the HASHES MinHash values agree (standard error 0.025
at 0.8), the sets of shingle hashes are made from the texts, and the pair is linked if their Jaccard similarity reaches `similarity`.

Texts are compared as lower-cased word sequences; equal ones (by a 128-bit digest) are one node, so a group of exact copies is one
entry. Links are spanning forests; components follow as in simhash_bk.

A shard above tree_size is dealt with in two rounds, so that a large group of near copies costs work in proportion to its size. First it
is cut into pieces, differently in every band, and each piece is searched alone. Then only pairs whose components still differ are open: of a
shard of n members of which m are outside its largest component, pieces of the n meet pieces of the m, which leaves out no pair.

Cases: null and blank texts are equal to each other; fewer words than a shingle are one shingle; repeated rows share a
component; rows without doc_id never name one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .simhash_bk import BKForest, _unite
from .storage import as_rows, materialize
from .textbatch import Words, blocks, give_back, majority_bits, mix, pieces, range_hash

HASHES, BANDS, BAND_VALUES = 256, 16, 4
RADIUS = 22
TREE_SIZE = 2048
#: Pairs of which so much less than `similarity` of the MinHash values agree are not compared exactly: six standard errors at 0.8.
MARGIN = 0.15
_BATCH, _QUERIES, _PAIRS, _FAR = 5_000, 256, 50_000, 500_000


def _shingles(column: pa.Array, words: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words, the hashes of all shingles text by text, and where each text's begin."""
    w = Words(column, lower=True)
    # A text of fewer words than a shingle is one, of all its words.
    count = np.maximum(w.counts - words + 1, 1)
    edges = np.cumsum(count) - count
    starts = np.arange(count.sum()) + np.repeat(w.docs[:-1] - edges, count)
    return w, range_hash(w.hashes(), starts, starts + np.repeat(np.minimum(words, w.counts), count)), edges


def signatures(column: pa.Array, words: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """For each text: digest of its word sequence, SimHash code, and HASHES MinHash values (u16)."""
    w, shingles, edges = _shingles(column, words)
    n = len(edges)
    least = np.full((HASHES, n), np.iinfo(np.uint64).max, dtype=np.uint64)
    multipliers = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
    for block, runs, begin in blocks(len(shingles), edges):
        own = shingles[block]
        for k in range(HASHES):
            np.minimum(least[k, runs], np.minimum.reduceat((own * multipliers[k]) ^ (own >> np.uint64(29)), begin), out=least[k, runs])
    # The least of a permutation's values, reduced to 16 bits that a mixed multiply spreads evenly.
    values = np.ascontiguousarray((mix(least) >> np.uint64(48)).astype(np.uint16).T)
    return w.digests(), majority_bits(shingles, edges), values


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def signed_documents(documents: DataFrame, words: int) -> DataFrame:
    """doc_id (long), key (digest of the text as written), digest (of its word sequence), code (long) and values (binary) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            digests, code, values = signatures(piece.column(2), words)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(digests, pa.binary()), pa.array(code.view(np.int64)), pa.array([v.tobytes() for v in values], pa.binary())], names=["doc_id", "key", "digest", "code", "values"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(_text()).alias("key"), _text().alias("text")).mapInArrow(run, "doc_id long, key string, digest binary, code long, values binary")


class ShingleSets:
    """Distinct shingle hashes of texts, made when a text is first asked for."""

    def __init__(self, texts: pa.Array, words: int):
        self.texts, self.words, self.sets = texts, words, [None] * len(texts)

    def _make(self, members: np.ndarray) -> None:
        missing = np.array([m for m in np.unique(members) if self.sets[m] is None], dtype=np.int64)
        at = 0
        for piece in pieces([pa.RecordBatch.from_arrays([self.texts.take(pa.array(missing))], names=["text"])], clean=False):
            _, shingles, edges = _shingles(piece.column(0), self.words)
            for own in np.split(shingles, edges[1:]):
                self.sets[missing[at]] = np.unique(own)
                at += 1

    def similar(self, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
        """Whether the sets of a[i] and b[i] have at least that Jaccard similarity."""
        out = np.zeros(len(a), dtype=bool)
        if not len(a):
            return out
        self._make(np.concatenate((a, b)))
        order = np.argsort(a, kind="stable")
        for run in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
            own = self.sets[a[run[0]]]
            for i in range(0, len(run), _QUERIES):
                part = run[i : i + _QUERIES]
                others = [self.sets[m] for m in b[part]]
                sizes = np.array([len(x) for x in others])
                every = np.concatenate(others)
                hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
                both = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
                out[part] = both >= similarity * (len(own) + sizes - both)
        return out


def _agree(values: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    out = np.zeros(len(a), dtype=bool)
    for i in range(0, len(a), _PAIRS):
        out[i : i + _PAIRS] = (values[a[i : i + _PAIRS]] == values[b[i : i + _PAIRS]]).mean(axis=1) >= similarity
    return out


def _rounds(groups: np.ndarray, asks: np.ndarray) -> Iterator[np.ndarray]:
    """The asking members in rounds: the first of every group, then twice as many of each, so that large sets are joined early."""
    new = np.ones(len(asks), dtype=bool)
    new[1:] = groups[asks][1:] != groups[asks][:-1]
    heads = np.flatnonzero(new)
    rank = np.arange(len(asks)) - heads[np.cumsum(new) - 1]
    level = np.frexp(rank.astype(np.float64))[1]
    for x in np.unique(level):
        own = asks[level == x]
        for i in range(0, len(own), _QUERIES):
            yield own[i : i + _QUERIES]


def _shard_links(codes: np.ndarray, values: np.ndarray, groups: np.ndarray, side: np.ndarray, roots: np.ndarray, sets: ShingleSets, similarity: float, radius: int) -> np.ndarray:
    """label: for each member the least member that links connect it to. Rows are sorted by group, side and code.

    Members with one root are connected from the start. Pairs within radius come first, then all others; only pairs that
    links connect already are not compared.
    """
    _, first, which = np.unique(roots, return_index=True, return_inverse=True)
    label = first[which]
    tree = np.flatnonzero(side == 0)
    new = np.ones(len(tree), dtype=bool)
    new[1:] = (groups[tree][1:] != groups[tree][:-1]) | (codes[tree][1:] != codes[tree][:-1])
    heads = np.flatnonzero(new)  # the tree has each code of a group once; its members stand together
    sizes = np.diff(np.append(heads, len(tree)))
    forest = BKForest(codes[tree[heads]], groups[tree[heads]])
    crossed = np.unique(groups[side == 1])
    asks = np.flatnonzero((side == 1) | ~np.isin(groups, crossed))

    def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        likely = np.flatnonzero(_agree(values, a, b, similarity - MARGIN))
        return likely[sets.similar(a[likely], b[likely], similarity)]

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        # First one member of each set that a query meets; what is still apart is compared in full.
        for once in (True, False):
            apart = (label[a] != label[b]) & (b < a)
            a, b = a[apart], b[apart]
            if once and len(a):
                _, one = np.unique(np.stack((a, label[b])), axis=1, return_index=True)
                linked = one[similar(a[one], b[one])]
                _unite(label, a[linked], b[linked])
            elif len(a):
                linked = similar(a, b)
                _unite(label, a[linked], b[linked])

    def spread(own: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(own, count), tree[np.repeat(first, count) + offset]

    for own in _rounds(groups, asks):
        q, at = forest.search(codes[own], groups[own], radius)
        compare(*spread(own[q], heads[at], sizes[at]))
    low, high = np.searchsorted(groups[tree], groups[asks]), np.searchsorted(groups[tree], groups[asks], side="right")
    begin = np.zeros(len(codes), dtype=np.int64)
    begin[asks] = low
    count = np.zeros(len(codes), dtype=np.int64)
    count[asks] = high - low
    for own in _rounds(groups, asks):
        upto = np.cumsum(count[own])
        for part in np.split(own, np.unique(np.searchsorted(upto, np.arange(_FAR, upto[-1], _FAR)))):
            if len(part):
                a, b = spread(part, begin[part], count[part])
                far = (label[a] != label[b]) & (np.bitwise_count(codes[a] ^ codes[b]) > radius)
                compare(a[far], b[far])
    return label


def _search(words: int, similarity: float, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def links(table: pa.Table) -> pa.RecordBatch:
            shard, cell, side, node, root, code = (table.column(c).to_numpy() for c in ("shard", "cell", "side", "node", "root", "code"))
            values = np.frombuffer(b"".join(table.column("values").to_pylist()), dtype=np.uint16).reshape(-1, HASHES)
            group = np.cumsum(np.concatenate(([0], (np.diff(shard) != 0) | (np.diff(cell) != 0))))
            sets = ShingleSets(table.column("text").combine_chunks(), words)
            label = _shard_links(code.astype(np.int64).view(np.uint64), values, group, side, root, sets, similarity, radius)
            moved = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], names=["u", "v"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= _BATCH:
                table = pa.Table.from_batches(held).combine_chunks()
                shard, cell = table.column("shard").to_numpy(), table.column("cell").to_numpy()
                last = int(np.flatnonzero((shard == shard[-1]) & (cell == cell[-1]))[0])
                if last:
                    yield links(table.slice(0, last))
                held, count = table.slice(last).to_batches(), len(table) - last
        if count:
            yield links(pa.Table.from_batches(held).combine_chunks())
        give_back()

    return run


def _searched(cells: DataFrame, words: int, similarity: float, radius: int) -> DataFrame:
    """(u, v) links of cells: shard, cell, side, node, root, code, values, text."""
    rows = cells.select("shard", "cell", "side", "node", "root", "code", "values", "text")
    return rows.repartition("shard", "cell").sortWithinPartitions("shard", "cell", "side", "code").mapInArrow(_search(words, similarity, radius), "u long, v long")


def _pieces_of(column: str, n: str, tree_size: int) -> Column:
    """The piece that a member falls into, of as many as n needs."""
    return F.pmod(F.xxhash64(column, "shard"), F.ceil(F.col(n) / tree_size)).cast("long")


def link_similar(nodes: DataFrame, texts: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """(node, root) of the nodes that links connect to others.

    nodes: node (long, unique), key, code, values. texts: key, text. Texts alone in all their shards are not sent on.
    """
    width = 2 * BAND_VALUES
    keys = F.array(*(F.xxhash64(F.lit(b), F.substring("values", b * width + 1, width)) for b in range(BANDS)))
    shards = materialize(nodes.select("node", F.explode(keys).alias("shard")), "similar-shards")
    sizes = materialize(shards.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "similar-sizes")
    met = materialize(shards.join(sizes, "shard"), "similar-met")
    wanted = nodes.join(met.select("node").distinct(), "node", "left_semi")
    known = materialize(texts.join(wanted, "key").dropDuplicates(["node"]).select("node", "code", "values", "text"), "similar-texts")
    alone = met.withColumns({"cell": _pieces_of("node", "n", tree_size), "side": F.lit(0).cast("long"), "root": F.col("node")})
    links = materialize(_searched(alone.join(known, "node"), words, similarity, radius), "similar-links")
    roots = materialize(connected_components(links), "similar-roots")
    large = sizes.filter(F.col("n") > tree_size)
    if large.isEmpty():
        return roots
    rooted = met.filter(F.col("n") > tree_size).join(roots, "node", "left").select("shard", "node", "n", F.coalesce("root", "node").alias("root"))
    counts = rooted.groupBy("shard", "root").agg(F.count(F.lit(1)).alias("members"))
    chief = counts.groupBy("shard").agg(F.max(F.struct("members", "root")).alias("most"), F.sum("members").alias("all"))
    chief = materialize(chief.filter(F.col("most.members") < F.col("all")).select(F.col("shard").alias("of"), F.col("most.root").alias("chief"), (F.col("all") - F.col("most.members")).alias("others")), "similar-chiefs")
    split = materialize(rooted.join(chief, F.col("shard") == F.col("of")).drop("of"), "similar-open")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / tree_size).cast("long") - 1))

    apart = F.lit(1 << 31)
    tree = split.withColumn("own", _pieces_of("node", "n", tree_size)).withColumn("other", every("others")).withColumn("side", F.lit(0).cast("long"))
    asks = split.filter("root <> chief").withColumn("other", _pieces_of("node", "others", tree_size)).withColumn("own", every("n")).withColumn("side", F.lit(1).cast("long"))
    cells = tree.unionByName(asks).withColumn("cell", F.col("own") * apart + F.col("other")).join(known, "node")
    more = _searched(cells, words, similarity, radius)
    return connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))


def _grouped(documents: DataFrame, words: int, similarity: float, tree_size: int = TREE_SIZE) -> DataFrame:
    """doc_id, key, node, root (a name of the group) and component_id for every row.

    What is joined on a node or a root that very many rows may have is written before, so that adaptive execution can split it.
    """
    rows = materialize(signed_documents(documents, words), "similar-rows")
    distinct = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.min("key").alias("key"), F.first("code").alias("code"), F.first("values").alias("values"))
    nodes = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "similar-nodes")
    texts = documents.select(F.md5(_text()).alias("key"), _text().alias("text"))
    roots = link_similar(nodes, texts, words, similarity, tree_size=tree_size).withColumnRenamed("node", "member")
    placed = materialize(nodes.join(roots, F.col("node") == F.col("member"), "left").select("digest", "node", "first_id", F.coalesce("root", "node").alias("root")), "similar-placed")
    least = materialize(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "similar-least").withColumnRenamed("root", "named")
    named = materialize(placed.join(least, F.col("root") == F.col("named")).select(F.col("digest").alias("own"), "node", "root", "component_id"), "similar-named")
    return rows.select("doc_id", "key", "digest").join(named, F.col("digest") == F.col("own")).select("doc_id", "key", "node", "root", "component_id")


def similar_groups(documents: DataFrame, words: int = 5, similarity: float = 0.8, tree_size: int = TREE_SIZE) -> DataFrame:
    """doc_id, node and component_id (least doc_id of the group) for every row."""
    return _grouped(documents, words, similarity, tree_size).select("doc_id", "node", "component_id")


def keep_first(documents: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """documents with one row for each group: that of the smallest doc_id, and of the texts with that doc_id in the group the least digest.

    Rows are told apart by doc_id and text, so different texts with one doc_id stay where their groups differ. Rows without a doc_id stay, as they cannot be told apart.
    Columns pass through whatever their names.
    """
    first = _grouped(documents, words, similarity).filter("doc_id = component_id").groupBy("root", "doc_id", "key").agg(F.count(F.lit(1)).alias("copies"))
    first = first.groupBy("root", "doc_id").agg(F.min(F.struct("key", "copies")).alias("least")).select(F.col("doc_id").alias("kept"), F.col("least.key").alias("kept_key"), F.col("least.copies").alias("copies"))
    own = as_rows(documents, id=F.col("doc_id").cast("long"), key=F.md5(_text()))
    found = own.join(first, (F.col("id") == F.col("kept")) & (F.col("key") == F.col("kept_key")))
    single = found.filter("copies = 1").select("row.*")
    repeated = found.filter("copies > 1").dropDuplicates(["id", "key"]).select("row.*")
    return single.unionByName(repeated).unionByName(documents.filter(F.col("doc_id").cast("long").isNull()))
