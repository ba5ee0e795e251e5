import itertools
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from graphwright.llm import filter_audit, oracle

from .conftest import DIRTY

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, labels):
    first, good, toxic = {}, set(), set()
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, q, t in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if t == 1 and i is not None else set()
    failed = []
    for i, text, source in rows:
        text = text or ""
        words = WORD.findall(text)
        tests = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and first[text] < i}
        failed.append((i, source or "", {k for k, v in tests.items() if v}))
    cells, due = defaultdict(Counter), Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for i, source, fails in failed:
            gone = False
            for step, letter in enumerate(order, 1):
                own = cells[source, order, step]
                if letter in fails:
                    own["redundant" if gone else "removed"] += 1
                    if not gone:
                        due[source, letter] += 1
                        own["good_lost"] += i in good
                        own["toxic_lost"] += i in toxic
                    own["unique_fails"] += len(fails) == 1
                    gone = True
                own["kept"] += not gone
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return sorted((*key, *(c[n] for n in names), due[key[0], key[1][key[2] - 1]]) for key, c in cells.items())


def check(spark, df, labels):
    found = sorted(tuple(r) for r in filter_audit.audit_sources(df, labels).collect())
    assert found == brute([tuple(r) for r in df.select("doc_id", "text", "source").collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    return found


def test_documents_and_sql(spark, documents, small):
    found = check(spark, documents, spark.read.parquet(f"{small}/labels.parquet"))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    assert sorted(con.execute(oracle.FILTER_AUDIT).fetchall()) == found


def test_all_cases(spark, dirty, empty):
    labels = spark.createDataFrame([(0, 1, 0), (0, None, 1), (3, 0, 1), (4, 1, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    check(spark, dirty, labels)
    more = dirty.unionByName(dirty).unionByName(dirty.withColumn("doc_id", F.when(F.col("doc_id") < 6, F.col("doc_id") + 100)))  # repeated rows, copies, null ids
    check(spark, more.unionByName(dirty.filter("doc_id = 7").withColumn("source", F.lit("other"))), labels)
    assert filter_audit.audit_sources(empty, labels).count() == 0
    assert filter_audit.audit_sources(dirty, labels.limit(0)).count() == 5 * 120 * len({r[3] or "" for r in DIRTY})


def test_potentials_of_any_game(spark):
    """Against marginal contributions, for a game that is no count of removals."""
    k, worth = 4, [(7 * s * s + 3 * s.bit_count() ** 3) % 101 if s else 0 for s in range(16)]
    row = filter_audit.with_potentials(spark.createDataFrame([(worth,)], "v array<long>"), "v", k).head()
    at = filter_audit.place(k)
    for i in range(k):
        total = 0
        for order in itertools.permutations(range(k)):
            before = sum(1 << j for j in order[: order.index(i)])
            total += worth[before | 1 << i] - worth[before]
        assert row["q"][at[15]] - k * row["q"][at[15 ^ (1 << i)]] == total


def test_own_filters(spark, dirty):
    masks = filter_audit.fail_masks(dirty, {"x": F.length("text") == 0, "y": F.length("text") > 100}, F.col("lang"))
    found = filter_audit.audit(filter_audit.mask_counts(masks, spark.createDataFrame([], "doc_id long, quality int, toxic int")), "XY").filter("part = 'de' and filter_order = 'YX' and step = 1").head()
    assert (found["removed"], found["shapley"], found["kept"]) == (1, 2, 2)
    with pytest.raises(ValueError):
        filter_audit.audit(filter_audit.mask_counts(masks, spark.createDataFrame([], "doc_id long, quality int, toxic int")), "ABCDEFGH")
