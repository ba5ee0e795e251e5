"""Substring dedup on a compacted De Bruijn graph of word windows.

Edges are the 13-word windows of a text, nodes their 12-word ends. The graph holds the edges of at least two documents; each
knows the least doc_id in which it starts, its source, and its coordinate there.

0. A document whose whole text a smaller doc_id has too is cut entirely (if it has a window); it needs no graph, and
   what others share with it they share with the smaller document. So a group of copies, however large, is one document below.
1. Prefilter: consecutive windows with the same minimizer (the least hash of the window's five-word parts) form pieces. Every
   piece sends (minimizer, doc_id), and only windows whose minimizer at least two documents have can be edges.
2. Edges are aggregated to their source document (96-bit hashes), and its windows are joined to find each edge's coordinate.
3. Compaction: the in- and out-degree of every node are counted. Edges that meet in a node with one way in and one way out, both of
   the same source, stand side by side in the source's text, so joining the degrees to the edges and following the coordinates
   contracts every nonbranching path to one unitig (source, first coordinate, number of edges).
4. The windows of later documents that are edges (a filter of the edges spares most others) are joined with the unitigs' edges. Windows that follow both the text and one unitig are one
   span of the document, which is joined with the unitig's words, taken from the source's text at its coordinates.
5. Per document the spans are verified: only where the document's own words are those of the source are they cut.

What decides in 1 which windows go on, and which texts are joined in 5, is a filter of fixed size that is broadcast; strangers that
it lets pass fall away in the exact steps. Beyond some 10^8 different repeated pieces it passes nearly everything: more work, same result.

Cases: null text has no words; texts of fewer than 13 words are never cut; rows with the same doc_id count as one
document (they don't cut each other) but each is cut by its own words; rows without a doc_id are neither cut nor a source; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import fixed_filter
from .storage import discard, materialize
from .textbatch import Words, mix, pieces, range_hash

WINDOW = 13
PART = 5
_WHOLE = -1


def _minimizers(hashes: np.ndarray, w: Words, first: np.ndarray, window: int, part: int) -> np.ndarray:
    """For every window the least hash of its parts."""
    parts = np.full(len(hashes), np.iinfo(np.uint64).max, dtype=np.uint64)
    at = w.windows(part)
    parts[at] = range_hash(hashes, at, at + part)
    least = parts[first]
    for k in range(1, window - part + 1):
        np.minimum(least, parts[first + k], out=least)
    return least


def _check(hashes: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """A second, independent hash of windows, 32 bits."""
    return (range_hash(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts, starts + window) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _ids(piece: pa.RecordBatch) -> np.ndarray:
    return piece.column(0).to_numpy(zero_copy_only=False).astype(np.int64)


def path_minimizers(rows: DataFrame, without: Broadcast | None, window: int, part: int) -> DataFrame:
    """(minimizer, doc_id) of every path piece; rows: doc_id (long, not null), text. Rows in the filter `without` are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(fixed_filter.select(batches, 0, without, False)):
            w = Words(piece.column(1))
            first = w.windows(window)
            least = _minimizers(w.hashes(), w, first, window, part)
            owner = w.owners()[first]
            new = np.ones(len(first), dtype=bool)
            new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(least[new].view(np.int64)), pa.array(_ids(piece)[owner[new]])], names=["minimizer", "doc_id"])

    return rows.mapInArrow(run, "minimizer long, doc_id long")


def candidate_edges(rows: DataFrame, only: Broadcast | None, inside: bool, cells: Broadcast, window: int, part: int | None, parts: tuple[str, ...]) -> DataFrame:
    """The windows of which the filter cells may hold the minimizer (of parts of `part` words; without part: the edge itself).

    Columns: edge, check, doc_id, and of key (of the row), start, prefix and suffix (nodes) what parts names.

    With a filter only, of the rows that it holds (inside) or lacks. It is applied here, so that a task has one Python worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = fixed_filter.load(cells)
        for piece in pieces(fixed_filter.select(batches, 0, only, inside)):
            w = Words(piece.column(1))
            first, hashes, owner = w.windows(window), w.hashes(), w.owners()
            edges = range_hash(hashes, first, first + window)
            held = fixed_filter.may_have(table, edges if part is None else _minimizers(hashes, w, first, window, part))
            first, edges = first[held], edges[held]
            own = owner[first]
            made = {
                "key": lambda: piece.column(2).to_numpy(zero_copy_only=False)[own], "start": lambda: (first - w.docs[own]).astype(np.int32),
                "prefix": lambda: range_hash(hashes, first, first + window - 1).view(np.int64), "suffix": lambda: range_hash(hashes, first + 1, first + window).view(np.int64),
            }
            yield pa.RecordBatch.from_arrays(
                [pa.array(edges.view(np.int64)), pa.array(_check(hashes, first, window)), pa.array(_ids(piece)[own]), *(pa.array(made[x]()) for x in parts)],
                names=["edge", "check", "doc_id", *parts],
            )

    kinds = {"key": "long", "start": "int", "prefix": "long", "suffix": "long"}
    return rows.mapInArrow(run, ", ".join(["edge long, check int, doc_id long", *(f"{x} {kinds[x]}" for x in parts)]))


def _text_check() -> Column:
    """Low 32 bits of the text's XXH64, signed; _whole_check is the same in Python."""
    return F.shiftright(F.shiftleft(F.xxhash64("text"), 32), 32).cast("int")


def _whole_check(text: str) -> int:
    return int(np.uint32(xxhash.xxh64_intdigest(text.encode(), 42) & 0xFFFFFFFF).view(np.int32))


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))


def whole_copies(documents: DataFrame) -> DataFrame:
    """(doc_id, key, digest, check) of the texts that a smaller doc_id has too."""
    texts = _rows(documents).filter("doc_id is not null and text <> ''").select("doc_id", "key", _digest().alias("digest"), _text_check().alias("check"))
    first = texts.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).filter("first_doc < last_doc")
    first = materialize(first, "copied-texts")
    return materialize(texts.join(first, "digest").filter("doc_id > first_doc").select("doc_id", "key", "digest", "check").distinct(), "whole-copies")


Part = tuple[DataFrame, Broadcast | None]


def without_copies(documents: DataFrame, copies: DataFrame) -> list[Part]:
    """The rows with a doc_id that are no whole copies, in two parts: (rows, filter of doc_ids to leave out).

    Only rows that the filter suspects are joined with the copies. The filter is applied by the task that computes, so a task
    has one Python worker.
    """
    rows, cells = _rows(documents).filter("doc_id is not null"), fixed_filter.build(copies.select("doc_id"))
    suspects = fixed_filter.suspects(rows, "doc_id", cells).withColumn("digest", _digest())
    return [(rows, cells), (suspects.join(copies, ["doc_id", "digest"], "left_anti").select("doc_id", "text", "key"), None)]


def _all(parts: list[Part], compute: Callable[[DataFrame, Broadcast | None], DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (compute(rows, cells) for rows, cells in parts))


def first_edges(parts: list[Part], window: int = WINDOW, part: int = PART) -> DataFrame:
    """(edge, check, first_doc): the windows of at least two documents, with the first of them."""
    spread = F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
    minimizers = _all(parts, lambda rows, without: path_minimizers(rows, without, window, part))
    shared = fixed_filter.build(minimizers.groupBy("minimizer").agg(*spread).filter("first_doc < last_doc").select("minimizer"))
    edges = _all(parts, lambda rows, without: candidate_edges(rows, without, False, shared, window, part, ()))
    return edges.groupBy("edge", "check").agg(*spread).filter("first_doc < last_doc").select("edge", "check", "first_doc")


def repeated_edges(rows: DataFrame, first: DataFrame, repeated: Broadcast, window: int = WINDOW) -> DataFrame:
    """(edge, check, first_doc, key, start, prefix, suffix): the first edges with their place in their document; repeated is the filter of the edges.

    Rows of a source that are whole copies are read as well: they have its windows at places of their own, which is right too.
    """
    sources = fixed_filter.build(first.select("first_doc").distinct())
    placed = candidate_edges(rows, sources, True, repeated, window, None, ("key", "start", "prefix", "suffix"))
    held = placed.withColumnRenamed("doc_id", "first_doc").join(first, ["edge", "check", "first_doc"])
    return held.groupBy("edge", "check", "first_doc").agg(F.min_by("key", "start").alias("key"), F.min("start").alias("start"), F.first("prefix").alias("prefix"), F.first("suffix").alias("suffix"))


def compact(edges: DataFrame) -> DataFrame:
    """(edge, check, first_doc, source_key, head, offset, start): every edge's unitig, named by its source and first coordinate, and the edge's place in it.

    edges as repeated_edges gives them. A path goes on where its node has one way in and one way out, of the same source.
    """
    ends = F.explode(F.array(F.struct(F.col("prefix").alias("node"), F.lit(0).alias("ins"), F.lit(1).alias("outs")), F.struct(F.col("suffix").alias("node"), F.lit(1).alias("ins"), F.lit(0).alias("outs"))))
    degrees = edges.select(ends.alias("end"), "first_doc").groupBy("end.node").agg(F.sum("end.ins").alias("ins"), F.sum("end.outs").alias("outs"), F.min("first_doc").alias("least"), F.max("first_doc").alias("most"))
    inner = degrees.filter("ins = 1 and outs = 1 and least = most").select("node", F.lit(True).alias("goes_on"))
    met = edges.join(inner, F.col("prefix") == F.col("node"), "left")
    along = Window.partitionBy("first_doc", "key").orderBy("start")
    begins = F.col("goes_on").isNull() | (F.lag("start").over(along).eqNullSafe(F.col("start") - 1) == F.lit(False))
    headed = met.withColumn("begin", F.when(begins, F.col("start"))).withColumn("head", F.last("begin", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return headed.select("edge", "check", "first_doc", F.col("key").alias("source_key"), "head", (F.col("start") - F.col("head")).alias("offset"))


def repeated_spans(parts: list[Part], window: int = WINDOW, part: int = PART) -> DataFrame:
    """(doc_id, key, start, first_doc, source_key, head, offset, n_edges): runs of windows that follow a unitig of a smaller doc_id.

    The unitigs' edges are written before the join, so that adaptive execution can split an edge that very many documents hold.
    """
    first = materialize(first_edges(parts, window, part), "first-edges", sweep=True)
    repeated = fixed_filter.build(first.select("edge"))
    edges = materialize(repeated_edges(parts[0][0], first, repeated, window), "edges", sweep=True)
    unitigs = materialize(compact(edges), "unitig-edges", sweep=True)
    discard(first, edges)
    later = _all(parts, lambda rows, without: candidate_edges(rows, without, False, repeated, window, None, ("key", "start")))
    met = later.join(unitigs, ["edge", "check"]).filter("doc_id > first_doc").select("doc_id", "key", "start", "first_doc", "source_key", "head", "offset")
    along = Window.partitionBy("doc_id", "key").orderBy("start")
    before = F.struct("start", "first_doc", "source_key", "head", "offset")
    wanted = F.struct(F.col("start") - 1, F.col("first_doc"), F.col("source_key"), F.col("head"), F.col("offset") - 1)
    follows = F.lag(before).over(along).eqNullSafe(wanted)
    runs = met.withColumn("run", F.sum(F.when(follows, 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ended = runs.groupBy("doc_id", "key", "run").agg(*(F.min(c).alias(c) for c in ("start", "first_doc", "source_key", "head", "offset")), F.count(F.lit(1)).cast("int").alias("n_edges"))
    return ended.drop("run")


def unitig_words(rows: DataFrame, spans: DataFrame, window: int = WINDOW) -> DataFrame:
    """(first_doc, source_key, head, words): the words of each unitig as far as spans need them, from the source's text."""
    wanted = spans.groupBy("first_doc", "source_key", "head").agg(F.max(F.col("offset") + F.col("n_edges")).alias("n_edges"))
    of = wanted.groupBy("first_doc", "source_key").agg(F.collect_list(F.struct("head", "n_edges")).alias("unitigs"))  # not more than the source has words
    sources = fixed_filter.suspects(rows.filter("doc_id is not null"), "doc_id", fixed_filter.build(of.select("first_doc")))
    found = sources.join(of, (F.col("doc_id") == F.col("first_doc")) & (F.col("key") == F.col("source_key"))).select("first_doc", "source_key", "text", "unitigs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            docs, keys, heads, words = [], [], [], []
            for doc, key, text, own in zip(*(c.to_pylist() for c in piece.columns)):
                split = text.encode().split()
                for x in own:
                    docs.append(doc)
                    keys.append(key)
                    heads.append(x["head"])
                    words.append(b" ".join(split[x["head"] : x["head"] + x["n_edges"] + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), pa.array(heads, pa.int32()), pa.array(words, pa.binary()).cast(pa.string())], names=["first_doc", "source_key", "head", "words"])

    made = found.mapInArrow(run, "first_doc long, source_key long, head int, words string")
    return made.dropDuplicates(["first_doc", "source_key", "head"])


def _cut(texts: list[str | None], marks: list[list[dict] | None], window: int) -> tuple[list[int], list[int], list[bytes], list[list[dict]]]:
    n_words, n_removed, kept, spans = [], [], [], []
    for text, mark in zip(texts, marks):
        words = (text or "").encode().split()
        n_words.append(len(words))
        own: list[dict] = []
        if mark and len(words) >= window:
            gone = np.zeros(len(words) + 2, dtype=np.int8)
            for m in mark:
                if m["start"] == _WHOLE:
                    if m["check"] == _whole_check(text):
                        gone[1:-1] = 1
                else:
                    source = m["words"].encode().split()
                    if words[m["start"] : m["start"] + len(source)] == source:
                        gone[m["start"] + 1 : m["start"] + 1 + len(source)] = 1
            edges = np.flatnonzero(np.diff(gone)).tolist()
            own = [{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2])]
            left: list[bytes] = []
            for s, e in zip([0, *edges[1::2]], [*edges[::2], len(words)]):
                left += words[s:e]
            words = left
        n_removed.append(n_words[-1] - len(words))
        kept.append(b" ".join(words))
        spans.append(own)
    return n_words, n_removed, kept, spans


def dedup_substrings(documents: DataFrame, window: int = WINDOW, part: int = PART) -> DataFrame:
    """doc_id, text (kept words), n_words, n_removed, kept_sha256 and spans (removed words, start to end) for every row."""
    rows, copies = _rows(documents), whole_copies(documents)
    spans = materialize(repeated_spans(without_copies(documents, copies), window, part), "repeated-spans", sweep=True)
    words = materialize(unitig_words(rows, spans, window), "unitig-words", sweep=True)
    source = F.when((F.col("offset") == 0) & (F.size(F.split("words", " ")) == F.col("n_edges") + window - 1), F.col("words"))
    source = source.otherwise(F.array_join(F.slice(F.split("words", " "), F.col("offset") + 1, F.col("n_edges") + window - 1), " "))
    marked_rows = spans.join(words, ["first_doc", "source_key", "head"]).select("doc_id", "key", "start", source.alias("words"), F.lit(None).cast("int").alias("check"))
    marked_rows = marked_rows.unionByName(copies.select("doc_id", "key", F.lit(_WHOLE).alias("start"), F.lit(None).cast("string").alias("words"), "check"))
    touched = fixed_filter.build(spans.select("doc_id").distinct().unionByName(copies.select("doc_id")))
    marks = marked_rows.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "words", "check")).alias("marks")).withColumnsRenamed({"doc_id": "marked", "key": "marked_key"})
    met = (F.col("doc_id") == F.col("marked")) & (F.col("key") == F.col("marked_key"))
    marked = fixed_filter.suspects(rows, "doc_id", touched).join(marks, met, "left").select("doc_id", "text", "marks")

    def cut(without: Broadcast | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in pieces(fixed_filter.select(batches, 0, without, False)):
                n_words, n_removed, kept, spans = _cut(piece.column(1).to_pylist(), piece.column(2).to_pylist() if without is None else [None] * piece.num_rows, window)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=["doc_id", "text", "n_words", "n_removed", "kept_sha256", "spans"],
                )

        return run

    schema = "doc_id long, text string, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    return rows.select("doc_id", "text").mapInArrow(cut(touched), schema).unionByName(marked.mapInArrow(cut(None), schema))
