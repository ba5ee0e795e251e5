import numpy as np
import pytest
from pyspark.sql import functions as F

from graphwright.llm import components, simhash_bk

from . import brute
from .conftest import DIRTY


def check(df, rows):
    prints = [brute.fingerprint(t) for _, t in rows]
    roots = brute.components(prints)
    least = {}
    for (d, _), r in zip(rows, roots):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    expected = sorted((d, f"{p:016x}", least.get(r)) for (d, _), p, r in zip(rows, prints, roots))
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()) == expected


@pytest.mark.parametrize("tree_size", [4096, 2])
def test_matches_brute_force(documents, rows, tree_size):
    check(simhash_bk.near_duplicates(documents, tree_size=tree_size), rows)


def test_edge_rows(dirty, empty):
    rows = [r[:2] for r in DIRTY]
    check(simhash_bk.near_duplicates(dirty), rows)
    check(simhash_bk.near_duplicates(dirty.unionByName(dirty)), rows + rows)
    assert simhash_bk.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("tree_size", [50, 100000])
def test_links_of_dense_clusters(spark, tree_size):
    r = np.random.default_rng(4)
    codes = set()
    for center in r.integers(0, 1 << 63, 12).tolist():
        for _ in range(60):
            code = center
            for bit in r.integers(0, 64, r.integers(0, 6)).tolist():
                code ^= 1 << bit
            codes.add(code)
    codes = sorted(codes)
    df = spark.createDataFrame([(int(np.uint64(c).view(np.int64)),) for c in codes], "fp long")
    roots = {row["node"]: row["root"] for row in components.connected_components(simhash_bk.link_fingerprints(df, tree_size=tree_size)).collect()}
    signed = [int(np.uint64(c).view(np.int64)) for c in codes]
    label = [roots.get(s, s) for s in signed]
    expected = brute.components(codes)
    pairs = set(zip(label, expected))
    assert len(pairs) == len(set(label)) == len(set(expected))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    out = components.connected_components(spark.createDataFrame(edges, "u long, v long"))
    got = {r["node"]: r["root"] for r in out.collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert out.filter(F.col("node").isNull()).count() == 0
