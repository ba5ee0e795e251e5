import numpy as np
import pytest
from pyspark.sql import functions as F

from graphwright.llm import line_dedup

from . import brute
from .conftest import DIRTY


def result(df):
    return sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in df.collect())


def expected(rows):
    return sorted((d, n, k, brute.sha(t)) for d, n, k, t in brute.line_dedup(rows))


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_matches_brute_force(documents, rows, limit):
    assert result(line_dedup.dedup_lines(documents, filter_bytes_limit=limit)) == expected(rows)


def test_edge_rows(dirty, empty):
    rows = [r[:2] for r in DIRTY]
    assert result(line_dedup.dedup_lines(dirty)) == expected(rows)
    assert line_dedup.dedup_lines(empty).count() == 0
    twice = line_dedup.dedup_lines(dirty.unionByName(dirty))
    assert result(twice) == sorted(2 * expected(rows))


def test_null_ids_keep_their_lines(spark):
    df = spark.createDataFrame([(None, "a line that repeats"), (1, "a line that repeats"), (2, "a line that repeats")], "doc_id long, text string")
    assert {(r["doc_id"], r["n_dropped"]) for r in line_dedup.dedup_lines(df).collect()} == {(None, 0), (1, 0), (2, 1)}


def test_cuckoo_filter_inserts_and_deletes():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    built = line_dedup.CuckooFilter.of(keys)
    assert built.may_have(keys).all()
    others = np.random.default_rng(2).integers(0, 1 << 63, 20000).astype(np.uint64)
    assert built.may_have(others).mean() < 0.001
    for k in keys[:2500].tolist():
        assert built.delete(k)
    assert built.may_have(keys[2500:]).all()
    assert built.may_have(keys[:2500]).mean() < 0.01
    again = line_dedup.CuckooFilter.load(built.dump())
    assert (again.table == built.table).all()


def test_index_is_reversible(spark, documents):
    index = line_dedup.LineIndex(spark)
    counts = lambda: {(bytes(r["key"]), r["n_docs"], r["first_doc"]) for r in index.counts().collect()}
    index.insert(documents.filter("doc_id < 60"))
    before = counts()
    index.insert(documents.filter("doc_id between 40 and 110"))
    assert counts() == {(bytes(r["key"]), r["n_docs"], r["first_doc"]) for r in line_dedup.reference_counts(line_dedup.postings(documents.filter("doc_id <= 110"))).collect()}
    index.delete(documents.filter("doc_id >= 60").select("doc_id"))
    assert counts() == before
    filters = {r["shard"]: line_dedup.CuckooFilter.load(bytes(r["cells"])) for r in index.filters().collect()}
    repeated = [bytes(r["key"]) for r in index.counts().filter(F.col("n_docs") > 1).collect()]
    shards, probes = line_dedup._probe(repeated, index.shards)
    assert all(filters[s].may_have(probes[i : i + 1])[0] for i, s in enumerate(shards.tolist()))


def test_routed_lines_are_what_the_filters_hold(spark, documents, monkeypatch):
    """A shard with a line of very many documents is dealt to several parts, and shards grow with the keys."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 1)
    posted = line_dedup.postings(documents)
    repeated = line_dedup.reference_counts(posted).filter("first_doc < last_doc").cache()
    shards = line_dedup.shards_for(repeated.count())
    assert shards > line_dedup.SHARDS or repeated.count() <= line_dedup.SHARDS
    routed = line_dedup.route_to_filters(posted, repeated, line_dedup.build_filters(repeated, shards), shards, part_rows=3)
    wanted = {(bytes(r["key"]), r["doc_id"]) for r in posted.join(repeated, "key", "left_semi").collect()}
    got = [(bytes(r["key"]), r["doc_id"]) for r in routed.collect()]
    assert len(got) == len(set(got)) and wanted <= set(got) and len(got) <= len(wanted) + posted.count() / 100


def test_index_is_opened_again_and_grows(spark, documents, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARDS", 2)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 8)
    index = line_dedup.LineIndex(spark)
    index.insert(documents.filter("doc_id < 100"))
    again = line_dedup.LineIndex(spark, index.path)
    assert again.version == index.version and again.shards == index.shards > 2
    again.insert(documents.filter("doc_id >= 100"))
    want = {(bytes(r["key"]), r["n_docs"]) for r in line_dedup.reference_counts(line_dedup.postings(documents)).collect()}
    assert {(bytes(r["key"]), r["n_docs"]) for r in again.counts().collect()} == want
    filters = {r["shard"]: line_dedup.CuckooFilter.load(bytes(r["cells"])) for r in again.filters().collect()}
    repeated = [k for k, n in want if n > 1]
    shards, probes = line_dedup._probe(repeated, again.shards)
    assert all(filters[s].may_have(probes[i : i + 1])[0] for i, s in enumerate(shards.tolist()))
