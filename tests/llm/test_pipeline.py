import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from graphwright.llm import decision_list, mixing

from . import brute
from .conftest import DIRTY


@pytest.fixture(scope="module")
def steps(spark, small):
    """Every stage's result over what the one before it left."""
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        done = stage(spark, docs, small)
        assert i == len(corpus_pipeline.STAGES) - 1 or done.columns == columns, name
        rows = done.collect()
        out.append(rows)
        if i < len(corpus_pipeline.STAGES) - 1:
            docs = spark.createDataFrame(rows, done.schema)
    return out


def test_stage_names():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_stages_match_brute_force(spark, small, steps):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    quality, unique, clean, mixed, tokens = steps
    judged = decision_list.judge(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
    assert {r["doc_id"] for r in quality} == {r[0] for r in judged.filter("kept").select("row.doc_id").collect()}
    assert all(r["text"] == docs[r["doc_id"]] for r in quality)
    ids = sorted(r["doc_id"] for r in quality)
    roots = brute.similar_groups([docs[i] for i in ids])
    assert sorted(r["doc_id"] for r in unique) == sorted({ids[r] for r in roots})
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    hit = {d for d, _, h, _ in brute.decontaminate([(r["doc_id"], r["text"]) for r in unique], items) if h}
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in unique} - hit
    frame = spark.createDataFrame(clean)
    taken = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in mixing.mix_sources(frame).collect()}
    assert sorted(r["doc_id"] for r in mixed) == sorted(d for d, n in taken.items() for _ in range(n))
    tokenizer, start, expected = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for r in sorted(mixed, key=lambda r: r["doc_id"]):
        own = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1]
        expected.append((r["doc_id"], start, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes())))
        start += len(own)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens) == sorted(expected)


def test_run_equals_the_stages(spark, small, steps):
    assert sorted(map(tuple, corpus_pipeline.run(spark, small).collect())) == sorted(map(tuple, steps[-1]))


def test_columns_of_the_input_are_kept_whatever_their_names(dirty, spark, small):
    named = dirty.selectExpr("*", "'a' as _text_key", "doc_id as _own", "'b' as text_key", "7 as copies", "'c' as _kept", "'d' as own", "9 as hit", "2 as copy", "1 as rows")
    before = {r["doc_id"]: r for r in named.collect()}
    for stage in [s for _, s in corpus_pipeline.STAGES[:4]]:
        out = stage(spark, named, small)
        assert out.columns == named.columns
        assert all(before[r["doc_id"]] == r for r in out.collect())


def test_mixed_documents_of_repeated_rows(dirty, empty):
    out = mixing.mixed_documents(dirty.unionByName(dirty))
    assert out.columns == dirty.columns
    taken = {}
    for r in mixing.mix_sources(dirty.unionByName(dirty)).collect():
        if r["size"]:
            taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"] // r["size"]
    got = {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {d: n for d, n in taken.items() if n}
    assert mixing.mixed_documents(empty).count() == 0 and len(DIRTY) == 12
