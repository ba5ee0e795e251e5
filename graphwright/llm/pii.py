"""PII: information-theoretic sanitisation, in DataFrame operations only.

Protected entities are the personal data that patterns find (e-mail and IP addresses, card and phone numbers). What else
gives them away is estimated from the corpus: with document frequencies n, a term t discloses an entity e to the degree
PMI(e; t) / IC(e), where PMI = log2(N n(e, t) / (n(e) n(t))) and IC = log2(N / n(e)); 1 means that the term occurs
with the entity only. In documents with the entity, terms from `disclosure` on are spans of kind "term": sanitize() replaces
patterns by their kind ([EMAIL]) and terms by [TERM], or removes them.

A pair is evidence only where chance would not give it: of V different terms of the corpus, V (m / M)^k are expected to have
k different texts with the entity and none without it, if m of M different texts have the entity. Pairs for which that exceeds `chance`
are left out, so two texts may be enough for a rare entity in a large corpus, while unique words of one text (or of its exact copies, which are
one observation) are not taken as giveaways. Terms are counted in texts from which the personal data are taken out, for the pair as for the
term alone. Counts cover all documents. An entity in a third of all documents costs what its texts'
words cost: pairs are aggregated before they are shuffled.

The patterns are written without backtracking over what can't match (possessive, with a look-behind at the start of a run),
so a long run costs linear time; they find what the plain patterns find.

Cases: null text is an empty one and has no spans; rows with the same doc_id are judged each by its own text; repeated
rows alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A cheap test that every text with a match passes.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
CHANCE = 0.05
DISCLOSURE = 0.95
_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def _running(lengths: Column) -> Column:
    """Sums of an array's elements up to and with each. Every pass adds what stands 1, 2, 4, ... places before, so n elements cost n log n."""
    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.size(lengths) + F.lit(1.0))).cast("int"))

    def add(sums: Column, i: Column) -> Column:
        return F.transform(sums, lambda x, at: x + F.coalesce(F.get(sums, at - F.pow(F.lit(2.0), i).cast("int")), F.lit(0)))

    return F.aggregate(passes, lengths, add)


def _located(text: Column, pattern: Column, kind: str) -> Column:
    """Spans of all matches: the texts between them, cut by the same pattern, give the positions (in code points)."""
    both = F.arrays_zip(F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("value"))

    def span(x: Column, end: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (end - F.length(x["value"])).alias("start"), end.alias("end"), x["value"].alias("value"))

    def spans(xs: Column) -> Column:
        ends = _running(F.transform(xs, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["value"]), F.lit(0))))
        return F.zip_with(xs, ends, span)

    # The one-element array binds the matches to a name, so that they are searched once.
    return F.filter(F.flatten(F.transform(F.array(both), spans)), lambda s: s["value"].isNotNull()).cast(_SPANS)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def weight(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + weight(i)) % 10 == 0


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.regexp_like(v, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$")),
    "card": lambda v: F.length(_digits(v)).between(16, 19) & _luhn(_digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}


def base_spans(text: Column) -> Column:
    """Valid matches of the four patterns, by kind in the order of KINDS, then start."""
    none = F.array().cast(_SPANS)

    def of(kind: str) -> Column:
        valid = F.filter(_located(text, F.lit(PATTERNS[kind]), kind), lambda s: VALID[kind](s["value"]))
        return F.when(F.regexp_like(text, F.lit(HINTS[kind])), valid).otherwise(none)

    return F.concat(*map(of, KINDS))


def _text(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_key") == F.col(f"{b}.text_key"))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM + "{2,}"), F.lit(0)))


def _without_base(text: Column) -> Column:
    """The text with a space for each valid match, one kind after the other. Texts that have no hint of a match stay untouched."""

    def stripped(of: Column, kind: str) -> Column:
        pattern = F.lit(PATTERNS[kind])
        left = F.zip_with(F.split(of, pattern), F.regexp_extract_all(of, pattern, F.lit(0)), lambda gap, v: F.concat(gap, F.when(v.isNull(), "").when(VALID[kind](v), " ").otherwise(v)))
        return F.when(F.regexp_like(of, F.lit(HINTS[kind])), F.array_join(left, "")).otherwise(of)

    def named(of: Column, kind: str) -> Column:
        # Bound to a name, as the expression holds the text several times.
        return F.transform(F.array(of), lambda t: stripped(t, kind))[0]

    for kind in KINDS:
        text = named(text, kind)
    return text


def find_base(documents: DataFrame) -> DataFrame:
    """doc_id, text_key, spans for every row, and the text of rows with spans."""
    found = _text(documents).select("doc_id", F.xxhash64("text").alias("text_key"), "text", base_spans(F.col("text")).alias("spans"))
    return materialize(found.withColumn("text", F.when(F.size("spans") > 0, F.col("text"))), "pii-base")


def term_counts(documents: DataFrame) -> DataFrame:
    """term, n_term: in how many rows. Every task counts its own rows' terms first, so what is shuffled are vocabularies, not texts."""
    terms = _text(documents).select(F.explode(_terms(_without_base(F.col("text")))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))


def _needed(texts: Column, all_texts: int, terms: int, chance: float) -> Column:
    """The least number of different texts with an entity in `texts` of them that chance gives to fewer than `chance` terms; null where none is enough."""
    least = F.ceil(F.log(F.lit(max(terms, 1) / chance)) / F.log(F.lit(float(all_texts)) / texts))
    return F.when(texts < all_texts, F.greatest(F.lit(1), least))


def entity_counts(base: DataFrame, terms: int, chance: float = CHANCE) -> DataFrame:
    """entity, n_entity (rows), texts (different ones) and needed (the texts that a pair needs) for every entity. Those of fewer texts than needed can't have a pair."""
    named = F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"]))))
    holders = base.filter("text is not null").select("text_key", F.explode(named).alias("entity"))
    counted = holders.groupBy("entity", "text_key").agg(F.count(F.lit(1)).alias("rows")).groupBy("entity").agg(F.sum("rows").alias("n_entity"), F.count(F.lit(1)).alias("texts"))
    return counted.withColumn("needed", _needed(F.col("texts"), base.select("text_key").distinct().count(), terms, chance))


def disclosing_terms(documents: DataFrame, base: DataFrame, chance: float = CHANCE, disclosure: float = DISCLOSURE) -> DataFrame:
    """(entity, term, degree) for the pairs that reach the threshold."""
    counts = materialize(term_counts(documents), "pii-term-counts")
    entity = F.concat_ws(":", F.col("span.kind"), F.lower(F.col("span.value")))
    held = base.filter("text is not null").select("doc_id", "text_key", "text", F.explode("spans").alias("span")).select("doc_id", "text_key", entity.alias("entity"), "text")
    pairs = held.select("doc_id", "text_key", "entity").distinct()
    # Rows are counted, repeated ones each, for entities as for terms and for both: a table and its double give the same degrees.
    entities = materialize(entity_counts(base, counts.count(), chance).filter(F.col("texts") >= F.col("needed")).drop("texts"), "pii-entities")
    shared = pairs.join(entities.select("entity"), "entity").select("doc_id", "text_key", "entity").alias("pair")
    texts = base.filter("text is not null").groupBy("doc_id", "text_key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))
    texts = texts.select("doc_id", "text_key", "times", _terms(_without_base(F.col("text"))).alias("terms")).alias("doc")
    joint = shared.join(texts, _same("pair", "doc")).select("pair.entity", "doc.text_key", "doc.times", F.explode("doc.terms").alias("term"))
    # Per text first: copies of a text are one row with a count, then texts are counted, not listed.
    joint = joint.groupBy("entity", "term", "text_key").agg(F.sum("times").alias("rows"))
    joint = joint.groupBy("entity", "term").agg(F.sum("rows").alias("n_both"), F.count(F.lit(1)).alias("texts"))
    joint = materialize(joint.join(entities, "entity").filter(F.col("texts") >= F.col("needed")).drop("texts", "needed"), "pii-pairs")
    total = F.lit(float(base.count()))
    degree = F.log2(total * F.col("n_both") / (F.col("n_entity") * F.col("n_term"))) / F.nullif(F.log2(total / F.col("n_entity")), F.lit(0.0))
    return joint.join(counts, "term").select("entity", "term", degree.alias("degree")).filter(F.col("degree") >= disclosure)


def find_spans(documents: DataFrame, chance: float = CHANCE, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, text_key, text (of rows with spans), base_spans and spans (base, then terms) for every row."""
    base = find_base(documents)
    disclosed = materialize(disclosing_terms(documents, base, chance, disclosure), "pii-terms")
    entity = F.concat_ws(":", F.col("span.kind"), F.lower(F.col("span.value")))
    owners = base.filter("text is not null").select("doc_id", "text_key", F.explode("spans").alias("span")).select("doc_id", "text_key", entity.alias("entity"))
    terms = owners.join(disclosed, "entity").groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    joined = base.alias("doc").join(terms.alias("own"), _same("doc", "own"), "left").select("doc.*", "own.terms")
    pattern = F.concat(F.lit(rf"(?<!{TERM})(?:"), F.array_join("terms", "|"), F.lit(rf")(?!{TERM})"))
    clear = lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    found = F.when(F.col("terms").isNotNull(), F.filter(_located(F.col("text"), pattern, "term"), clear)).otherwise(F.array().cast(_SPANS))
    return joined.select("doc_id", "text_key", "text", F.col("spans").alias("base_spans"), F.concat("spans", found).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summarize(found: DataFrame) -> DataFrame:
    def number(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, KINDS), F.sha2(spans_text(F.col("base_spans")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def sanitize(documents: DataFrame, chance: float = CHANCE, disclosure: float = DISCLOSURE, remove_terms: bool = False) -> DataFrame:
    """doc_id, text (sanitised) and spans for every row of documents."""
    found = find_spans(documents, chance, disclosure).select("doc_id", "text_key", "text", "spans").dropDuplicates(["doc_id", "text_key"])
    rows = _text(documents).withColumn("text_key", F.xxhash64("text"))
    order = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(so_far: Column, s: Column) -> Column:
        label = F.when((s["kind"] == "term") & F.lit(remove_terms), "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        text = F.concat(so_far["out"], F.substring(F.col("raw"), so_far["at"] + 1, s["start"] - so_far["at"]), label)
        return F.struct(F.greatest(so_far["at"], s["end"]).alias("at"), F.when(s["start"] >= so_far["at"], text).otherwise(so_far["out"]).alias("out"))

    joined = rows.alias("doc").join(found.alias("hit"), _same("doc", "hit")).select("doc.doc_id", F.col("doc.text").alias("raw"), "hit.spans").withColumn("done", F.aggregate(order, start, step))
    return joined.select("doc_id", F.concat(F.col("done.out"), F.substring(F.col("raw"), F.col("done.at") + 1, F.length("raw"))).alias("text"), "spans")
