import random

import numpy as np

from graphwright.llm import fixed_filter, substring_dedup

from . import brute
from .conftest import DIRTY


def result(df):
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


def expected(rows, k=13):
    return sorted((d, n, k_, brute.sha(t)) for d, n, k_, t in brute.substring_dedup(rows, k))


def test_matches_brute_force(documents, rows):
    out = substring_dedup.dedup_substrings(documents)
    assert result(out) == expected(rows)
    for r in out.collect():
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_edge_rows(dirty, empty, spark):
    rows = [r[:2] for r in DIRTY]
    assert result(substring_dedup.dedup_substrings(dirty)) == expected(rows)
    assert result(substring_dedup.dedup_substrings(dirty.unionByName(dirty))) == sorted(2 * expected(rows))
    assert substring_dedup.dedup_substrings(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(None, text), (4, text), (5, "x y " + text), (5, text)], "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup.dedup_substrings(df).orderBy("doc_id", "n_words").collect()] == [0, 0, 20, 20]


def edges_of(docs, k=13):
    """Edge table of texts as repeated_edges() gives it, by plain Python; nodes and edges are numbered."""
    number, found = {}, {}
    for d, t in sorted(docs):
        w = t.split()
        for i in range(len(w) - k + 1):
            found.setdefault(tuple(w[i : i + k]), []).append((d, i))
    name = lambda x: number.setdefault(x, len(number))
    return [(name(e), 0, at[0][0], 1, at[0][1], name(e[:-1]), name(e[1:])) for e, at in found.items() if len({d for d, _ in at}) > 1]


def test_paths_end_at_branching_nodes(spark):
    """Two texts share 40 words; a third shares the first 25 of them and goes on otherwise, like a fourth: one branching node."""
    w = [f"w{i}" for i in range(40)]
    other = [f"v{i}" for i in range(15)]
    docs = [(1, " ".join(w)), (2, " ".join(w)), (3, " ".join(w[:25] + other)), (4, " ".join(w[:25] + other))]
    edges = spark.createDataFrame(edges_of(docs), "edge long, check int, first_doc long, key long, start int, prefix long, suffix long")
    got = {(r["first_doc"], r["head"]): r["n"] for r in substring_dedup.compact(edges).groupBy("first_doc", "head").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    # 13 edges lead to the node (words 13 to 24), from which 15 go on in document 1 and 15 in document 3.
    assert got == {(1, 0): 13, (1, 13): 15, (3, 13): 15}


def test_texts_that_a_polynomial_confuses(spark):
    one = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    two = one.translate(str.maketrans("ab", "ba"))
    docs = [(i, " ".join([f"w{k}" for k in range(12)] + [x])) for i, x in enumerate((one, two))]
    out = substring_dedup.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string"))
    assert [r["n_removed"] for r in out.collect()] == [0, 0]


def test_rows_of_one_doc_id_are_cut_each_by_its_words(spark):
    r = random.Random(4)
    w = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(60):
        at, n = r.randrange(100), r.randrange(5, 60)
        docs.append((r.randrange(20), " ".join(r.choices("xyz", k=r.randrange(4)) + w[at : at + n] + r.choices("xyz", k=3) + w[: r.randrange(30)])))
    first = {}
    for d, t in docs:
        x = t.split()
        for i in range(len(x) - 12):
            first[tuple(x[i : i + 13])] = min(d, first.get(tuple(x[i : i + 13]), d))
    expected = []
    for d, t in docs:
        x = t.split()
        gone = {i + k for i in range(len(x) - 12) if first[tuple(x[i : i + 13])] < d for k in range(13)}
        expected.append((d, len(x), len(gone), brute.sha(" ".join(v for i, v in enumerate(x) if i not in gone))))
    assert result(substring_dedup.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))) == sorted(expected)


def test_other_window(documents, rows):
    assert result(substring_dedup.dedup_substrings(documents, window=6, part=3)) == expected(rows, 6)


def test_fixed_filter_has_no_misses(spark):
    df = spark.range(0, 50000).selectExpr("xxhash64(id) as k")
    cells = fixed_filter.load(fixed_filter.build(df))
    keys = np.array([r["k"] for r in df.collect()], dtype=np.int64).view(np.uint64)
    assert fixed_filter.may_have(cells, keys).all()
    assert fixed_filter.may_have(cells, keys + np.uint64(1)).mean() < 0.01
