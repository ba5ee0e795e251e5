"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

1. Frequencies of the benchmark's terms are counted over all documents.
2. Every window of `length` consecutive item words is looked up from its rarest terms: the index stores the postings
   (term, document, position) of each window's two rarest terms.
3. Offset-adjusted, a posting says where in the document the item would begin. The lists of the rarest and the second
   rarest term are intersected on (document, item, begin).
4. Where both agree, the item's words are compared with the document's; all windows that are equal there are matches.

Items and their terms are broadcast only if all items have at most BROADCAST_TERMS words (a bound on their size); beyond that,
frequencies are aggregated before the join and postings are joined by a shuffle.

Cases: null texts have no words; an item shorter than a window is one window; items without words match nothing, and
items without an id are ignored; rows with the same doc_id are judged each by its own text; repeated rows alike;
an empty documents table gives an empty result, an empty benchmark marks nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import as_rows, materialize

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LENGTH = 10
BROADCAST_TERMS = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged. lower() is that, and faster, for texts of ASCII only."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def terms(text: Column) -> Column:
    """Words of a text as an array; separators can leave one empty string at either end."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text_key and text: rows with the same doc_id and text share all results."""
    return documents.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_key") == F.col(f"{b}.text_key"))


def term_frequencies(documents: DataFrame, vocabulary: DataFrame, small: bool) -> DataFrame:
    """(term, frequency) over all words of documents for the terms of vocabulary that occur."""
    words = documents.select(F.explode(terms(F.col("text"))).alias("term"))
    if small:
        return words.join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count(F.lit(1)).alias("frequency"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("frequency")).join(vocabulary, "term")


def positional_index(documents: DataFrame, vocabulary: DataFrame, small: bool) -> DataFrame:
    """(term, doc_id, text_key, position) of the words of documents that are in vocabulary."""
    words = _keyed(documents).select("doc_id", "text_key", F.posexplode(terms(F.col("text"))).alias("position", "term"))
    return words.join(F.broadcast(vocabulary) if small else vocabulary, "term").select("term", "doc_id", "text_key", "position")


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item (string id), item_key, words: each different (id, words) once."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), terms(F.col("text")).alias("words")).filter("item is not null and size(words) > 0")
    return items.withColumn("item_key", F.xxhash64("item", "words")).dropDuplicates(["item_key"])


def window_anchors(items: DataFrame, frequencies: DataFrame, length: int) -> DataFrame:
    """(item_key, rank 1 or 2, place, term): places in the item of the rarest and second rarest term of each window that can occur."""
    span = F.least(F.size("words"), F.lit(length))
    windows = items.select("item_key", "words", F.explode(F.sequence(F.lit(0), F.size("words") - span)).alias("begin"), span.alias("span"))
    cells = windows.select("item_key", "begin", "span", F.posexplode(F.slice("words", F.col("begin") + 1, F.col("span"))).alias("offset", "term"))
    order = Window.partitionBy("item_key", "begin").orderBy("frequency", "offset")
    ranked = cells.join(frequencies, "term").withColumns({
        "rank": F.row_number().over(order),
        "known": F.count(F.lit(1)).over(Window.partitionBy("item_key", "begin")),
    })
    possible = ranked.filter((F.col("known") == F.col("span")) & (F.col("rank") <= 2))
    single = possible.filter("span = 1").withColumn("rank", F.lit(2))
    return possible.unionByName(single).select("item_key", "rank", (F.col("begin") + F.col("offset")).alias("place"), "term").distinct()


def find_matches(documents: DataFrame, benchmark: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text_key, item, start, span): every exact occurrence of a benchmark window."""
    items = materialize(benchmark_items(benchmark), "benchmark-items")
    vocabulary = items.select(F.explode("words").alias("term")).distinct()
    small = (items.agg(F.sum(F.size("words"))).head()[0] or 0) <= BROADCAST_TERMS
    frequencies = materialize(term_frequencies(documents, vocabulary, small), "term-frequencies")
    anchors = materialize(window_anchors(items, frequencies, length), "window-anchors")
    index = materialize(positional_index(documents, anchors.select("term").distinct(), small), "positional-index")

    def begins(rank: int) -> DataFrame:
        own = anchors.filter(F.col("rank") == rank).select("term", "item_key", "place")
        own = F.broadcast(own) if small else own
        return index.join(own, "term").select("doc_id", "text_key", "item_key", (F.col("position") - F.col("place")).alias("begin")).distinct()

    one, two = begins(1).alias("one"), begins(2).alias("two")
    both = one.join(two, _same("one", "two") & (F.col("one.item_key") == F.col("two.item_key")) & (F.col("one.begin") == F.col("two.begin")), "left_semi")
    lengths = items.select("item_key", F.size("words").alias("n"))
    placed = both.join(F.broadcast(lengths) if small else lengths, "item_key").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("item_key", "begin", "n")).alias("places")).alias("at")
    # A document is split once: explode() of a one-element array keeps the words as a value, so that the
    # places' slices do not each split the text anew.
    split = _keyed(documents).alias("doc").join(placed, _same("doc", "at")).select("doc.doc_id", "doc.text_key", "at.places", F.explode(F.array(terms(F.col("doc.text")))).alias("words"))
    cut = F.transform("places", lambda p: F.struct(p["item_key"].alias("item_key"), p["begin"].alias("begin"), F.slice("words", F.greatest(F.lit(1), p["begin"] + 1), F.least(p["n"], p["n"] + p["begin"])).alias("here")))
    here = split.select("doc_id", "text_key", F.inline(cut))
    wanted = items.select("item_key", "item", F.col("words").alias("wanted"))
    span, skipped = F.least(F.size("wanted"), F.lit(length)), F.greatest(F.lit(0), -F.col("begin"))
    last = skipped + F.size("here") - span
    equal = F.filter(F.sequence(skipped, last), lambda s: F.slice("wanted", s + 1, span) == F.slice("here", s - skipped + 1, span))
    found = here.join(F.broadcast(wanted) if small else wanted, "item_key").filter(last >= skipped)
    return found.select("doc_id", "text_key", "item", F.explode(F.transform(equal, lambda s: s + F.col("begin"))).alias("start"), span.alias("span"))


def contamination(documents: DataFrame, benchmark: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids), items_sha256 and contaminated for every row."""
    before = Window.partitionBy("doc_id", "text_key").orderBy("start", "span", "item").rowsBetween(Window.unboundedPreceding, -1)
    matches = find_matches(documents, benchmark, length).withColumn("reached", F.coalesce(F.max(F.col("start") + F.col("span")).over(before), F.lit(0)))
    hits = matches.groupBy("doc_id", "text_key").agg(
        F.sum(F.greatest(F.lit(0), F.col("start") + F.col("span") - F.greatest("start", "reached"))).alias("n_hit"), F.sort_array(F.collect_set("item")).alias("items"))
    counted = _keyed(documents).select("doc_id", "text_key", F.size(terms(F.col("text"))).cast("long").alias("n_words"))
    joined = counted.alias("doc").join(hits.alias("hit"), _same("doc", "hit"), "left")
    items = F.coalesce(F.col("hit.items"), F.array().cast("array<string>"))
    return joined.select(
        "doc.doc_id", "doc.n_words", F.coalesce(F.col("hit.n_hit"), F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.coalesce(F.col("hit.n_hit"), F.lit(0)) > 0).alias("contaminated"),
    )


def proximity_matches(index: DataFrame, phrases: DataFrame, slop: int) -> DataFrame:
    """(phrase, doc_id, text_key, position): occurrences of a phrase's rarest term with all its other terms at most slop words away.

    index: a positional index over at least the phrases' terms. phrases: (phrase, term), each pair once.
    """
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("frequency"))
    wanted = phrases.join(counts, "term").withColumns({
        "rank": F.row_number().over(Window.partitionBy("phrase").orderBy("frequency", "term")), "known": F.count(F.lit(1)).over(Window.partitionBy("phrase"))})
    sizes = phrases.groupBy("phrase").agg(F.count(F.lit(1)).alias("n_terms"))
    wanted = wanted.join(sizes, "phrase").filter("known = n_terms")
    hits = index.join(wanted.select("phrase", "term", "rank", "n_terms"), "term")
    block = F.floor(F.col("position") / (slop + 1))
    rare = hits.filter("rank = 1").select("phrase", "doc_id", "text_key", "n_terms", "position", F.explode(F.array(block - 1, block, block + 1)).alias("block")).alias("a")
    other = hits.select("phrase", "doc_id", "text_key", "term", "position", block.alias("block")).alias("b")
    near = rare.join(other, _same("a", "b") & (F.col("a.phrase") == F.col("b.phrase")) & (F.col("a.block") == F.col("b.block"))).filter(F.abs(F.col("a.position") - F.col("b.position")) <= slop)
    return near.groupBy("a.phrase", "a.doc_id", "a.text_key", "a.position", "a.n_terms").agg(F.countDistinct("b.term").alias("n")).filter("n = n_terms").select("phrase", "doc_id", "text_key", "position")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, length: int = LENGTH) -> DataFrame:
    """documents without the rows in which a benchmark window occurs."""
    hits = find_matches(documents, benchmark, length).select("doc_id", "text_key").distinct().alias("hit")
    own = as_rows(documents, doc_id=F.col("doc_id"), text_key=F.xxhash64("text")).alias("doc")
    return own.join(hits, _same("doc", "hit"), "left_anti").select("row.*")
