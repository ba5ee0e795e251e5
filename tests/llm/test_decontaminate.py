import pytest

from graphwright.llm import decontaminate

from . import brute
from .conftest import DIRTY


def check(df, rows, items):
    expected = sorted((d, n, h, len(found), brute.sha(",".join(found)), h > 0) for d, n, h, found in brute.decontaminate(rows, items))
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect()) == expected


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_matches_brute_force(documents, rows, spark, small, limit, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_TERMS", limit)
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    check(decontaminate.contamination(documents, benchmark), rows, items)


def test_edge_rows(dirty, empty, spark):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "WÖRTER äöü"), (3, None), (4, "... !"), (5, "text"), (6, "seven eight nine"), (5, "own line number"),
             (7, "twelve thirteen fourteen fifteen and much more that is not there"), (8, "zero zero one two three four five six seven eight nine ten"), (None, "one two")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    known = [x for x in items if x[0] is not None]
    rows = [r[:2] for r in DIRTY]
    check(decontaminate.contamination(dirty, benchmark), rows, known)
    check(decontaminate.contamination(dirty.unionByName(dirty), benchmark.unionByName(benchmark)), rows + rows, known)
    assert decontaminate.contamination(empty, benchmark).count() == 0
    assert decontaminate.contamination(dirty, benchmark.limit(0)).filter("contaminated").count() == 0
    kept = decontaminate.drop_contaminated(dirty, benchmark)
    assert kept.columns == dirty.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _, h, _ in brute.decontaminate(rows, known) if not h}


def test_same_id_different_texts(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "x y"), (None, "b c"), (2, "b x c")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(9, "b c")], "item_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"]) for r in decontaminate.contamination(df, benchmark).collect()) == [("1", 2, 0), ("1", 4, 2), ("2", 3, 0), ("None", 2, 2)]


def test_proximity(spark):
    df = spark.createDataFrame([(1, "alpha x x beta y gamma"), (2, "gamma beta alpha"), (3, "alpha beta"), (4, "alpha " + "x " * 9 + "beta gamma")], "doc_id long, text string")
    phrases = spark.createDataFrame([("p", "alpha"), ("p", "beta"), ("p", "gamma")], "phrase string, term string")
    index = decontaminate.positional_index(df, phrases.select("term").distinct(), True)
    near = {r["doc_id"] for r in decontaminate.proximity_matches(index, phrases, 5).collect()}
    assert near == {1, 2}


def test_no_python_in_the_plan(documents, spark, small):
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    plan = decontaminate.contamination(documents, benchmark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
