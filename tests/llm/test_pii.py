import math
import random
import re
import time

from graphwright.llm import pii

from . import brute
from .conftest import DIRTY

HARD = [
    (20, "a@b.c_d@e.f x@y x@y. .a@b.c..d a@-.- %+@a.b@c.d"),
    (21, "1.2.3.4.5.6.7.8 1..2.3.4.5 256.1.1.1 0255.001.1.1 1.2.3 99999999999999999999.1.1.1 1.2.3.4a"),
    (22, "4111111111111111 4111-1111 1111-1111 4111 1111 1111 1112 41111111111111111111 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 5500--0000"),
    (23, "+1 (606) 555-7814 +12 +1234567 +1-2-3-4-5-6-7-8) +1 23456789012345678 ++44 20 7946 0958. +44"),
    (24, "é😀 a@b.cc 10.0.0.1 日本 a@b.cc"),
    (25, "1" * 5000 + " " + "a" * 5000 + "@" + " 1" * 5000),
    (26, "1.1.1.1 " * 3000),
]


def expected(rows):
    out = []
    for d, t in rows:
        found = brute.pii(t)
        out.append((str(d), *(sum(k == kind for k, *_ in found) for kind in pii.KINDS), brute.sha(",".join(f"{k}:{s}:{e}" for k, s, e in found))))
    return sorted(out)


def result(df):
    return sorted((str(r["doc_id"]), r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in df.collect())


def test_base_matches_brute_force(documents, rows):
    out = pii.summarize(pii.find_spans(documents))
    assert result(out) == expected(rows)
    texts = dict(rows)
    for r in out.collect():
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in brute.pii(texts[r["doc_id"]]))
        assert r["spans"].startswith(base)


def test_hard_and_edge_rows(spark, dirty, empty):
    df = spark.createDataFrame(HARD, "doc_id long, text string")
    assert result(pii.summarize(pii.find_spans(df))) == expected(HARD)
    rows = [r[:2] for r in DIRTY]
    assert result(pii.summarize(pii.find_spans(dirty))) == expected(rows)
    assert result(pii.summarize(pii.find_spans(dirty.unionByName(dirty)))) == sorted(2 * expected(rows))
    assert pii.summarize(pii.find_spans(empty)).count() == 0


def test_disclosing_terms(spark):
    rows = [(i, f"filler{i} Zanzibar met bob@example.com on common day {i}") for i in range(6)]
    rows += [(i, f"other{i} common day with words {i}") for i in range(6, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find_spans(df)
    terms = {t["term"] for t in pii.disclosing_terms(df, pii.find_base(df)).collect()}
    assert terms == {"Zanzibar", "met", "on"}
    for r in found.collect():
        marked = [s["value"] for s in r["spans"]]
        assert marked == (["bob@example.com", "Zanzibar", "met", "on"] if r["doc_id"] < 6 else [])
        assert all(r["text"][s["start"] : s["end"]] == s["value"] for s in r["spans"])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitize(df).collect()}
    assert clean[0] == "filler0 [TERM] [TERM] [EMAIL] [TERM] common day 0"
    assert clean[10] == "other10 common day with words 10"
    removed = {r["doc_id"]: r["text"] for r in pii.sanitize(df, remove_terms=True).collect()}
    assert re.sub(" +", " ", removed[0]) == "filler0 [EMAIL] common day 0"


def test_terms_need_different_texts(spark):
    df = spark.createDataFrame([(i, "Zanzibar met bob@example.com") for i in range(9)] + [(9, "nothing")], "doc_id long, text string")
    assert pii.disclosing_terms(df, pii.find_base(df)).count() == 0


def test_terms_inside_addresses_do_not_count(spark):
    rows = [(i, f"doc{i} bob wrote from 10.0.0.1") for i in range(4)] + [(i, f"doc{i} mail to bob@example.com please") for i in range(4, 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["entity"], r["term"]) for r in pii.disclosing_terms(df, pii.find_base(df)).collect()}
    assert {("ip:10.0.0.1", t) for t in ("bob", "wrote", "from")} <= found


def test_very_many_matches_in_one_text(spark):
    n = 60_000
    df = spark.createDataFrame([(1, "a@b.cc " * n)], "doc_id long, text string")
    began = time.time()
    spans = pii.find_base(df).select("spans.start", "spans.end").head()
    assert spans["start"] == [7 * i for i in range(n)] and spans["end"] == [7 * i + 6 for i in range(n)]
    assert time.time() - began < 60


def test_no_python_in_the_plan(documents):
    plan = pii.summarize(pii.find_spans(documents))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_repeated_rows_change_no_degree(spark):
    rows = [(i, f"filler{i} Zanzibar met bob@example.com bob@example.com on common day {i}") for i in range(6)]
    rows += [(i, f"other{i} common day with words {i}") for i in range(6, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    degrees = lambda x: {(r["entity"], r["term"], round(r["degree"], 9)) for r in pii.disclosing_terms(x, pii.find_base(x)).collect()}
    once = degrees(df)
    assert {t for _, t, _ in once} == {"Zanzibar", "met", "on"}
    assert degrees(df.unionByName(df)) == once == degrees(df.unionByName(df).unionByName(df))


def _evidence(rows, chance=pii.CHANCE, disclosure=pii.DISCLOSURE):
    """Pairs and degrees by listing, for texts whose only personal data are addresses set off by spaces."""
    texts = [(t, {f"email:{w}" for w in t.split() if "@" in w}, {w for w in t.split() if "@" not in w and len(w) > 1}) for _, t in rows]
    vocabulary, different, out = set().union(*(w for *_, w in texts)), {t for t, *_ in texts}, {}
    for entity in set().union(*(e for _, e, _ in texts)):
        n_entity, m = sum(entity in e for _, e, _ in texts), len({t for t, e, _ in texts if entity in e})
        for term in vocabulary:
            both = [t for t, e, w in texts if entity in e and term in w]
            if not both or m == len(different) or len(vocabulary) * (m / len(different)) ** len(set(both)) > chance:
                continue
            n_term = sum(term in w for *_, w in texts)
            degree = math.log2(len(rows) * len(both) / (n_entity * n_term)) / math.log2(len(rows) / n_entity)
            if degree >= disclosure:
                out[entity, term] = round(degree, 9)
    return out


def test_evidence_matches_brute_force(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(("alpha", "beta", "gamma", "delta")) + str(r.randrange(4)) for _ in range(12))) for i in range(400)]
    rows += [(400 + i, f"Zanzibar{i // 2} {'common' + str(i)} people met rare{i // 2}@b.com alpha1") for i in range(8)]  # entities of two texts each
    rows += [(500 + i, "Quito people copied@b.com beta2") for i in range(30)]  # one text, thirty rows
    rows += [(600 + i, f"Lima people hot@b.com gamma{i % 5} number{i}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(x["entity"], x["term"]): round(x["degree"], 9) for x in pii.disclosing_terms(df, pii.find_base(df)).collect()}
    assert found == _evidence(rows)
    assert {("email:rare0@b.com", "Zanzibar0"), ("email:hot@b.com", "Lima")} <= set(found) and not any(e == "email:copied@b.com" for e, _ in found)
    judged = {x["entity"]: x["texts"] >= (x["needed"] or math.inf) for x in pii.entity_counts(pii.find_base(df), pii.term_counts(df).count()).collect()}
    assert judged["email:rare0@b.com"] and judged["email:hot@b.com"] and not judged["email:copied@b.com"]
