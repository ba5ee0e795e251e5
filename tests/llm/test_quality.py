import numpy as np
import pytest

from graphwright.llm import decision_list, quality_mil

from . import brute
from .conftest import DIRTY

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_counts_match_brute_force(corpus, dirty, empty):
    out = decision_list.with_counts(corpus).select("row.doc_id", "row.text", *BASE).collect()
    assert [tuple(r[c] for c in BASE) for r in out] == [brute.quality_counts(r["text"]) for r in out]
    out = {r["doc_id"]: tuple(r[c] for c in BASE) for r in decision_list.with_counts(dirty).select("row.doc_id", *BASE).collect()}
    assert out == {r[0]: brute.quality_counts(r[1]) for r in DIRTY}
    assert decision_list.with_counts(empty).count() == 0


def test_rules_reject_labelled_junk_and_keep_the_rest(corpus, labels):
    judged = decision_list.judge(corpus, labels).select("row.doc_id", *BASE, "base_failed", "kept").join(labels, "doc_id").collect()
    for r in judged:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    good = [r["kept"] for r in judged if r["quality"] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in judged if r["quality"] == 0]
    assert np.mean(good) > 0.98
    assert np.mean(bad) < 0.15


def test_judge_without_labels_and_empty(dirty, empty, labels, spark):
    none = labels.limit(0)
    assert {r["kept"] for r in decision_list.judge(dirty, none).filter("not base_failed").collect()} <= {True}
    assert decision_list.judge(empty, labels).count() == 0
    assert decision_list.keep_documents(dirty, none).columns == dirty.columns


def test_learn_finds_a_threshold():
    x = np.random.default_rng(0).random((600, 2))
    bad = x[:, 0] > 0.7
    rules = decision_list.learn(x, bad, ["a", "b"])
    hit = np.zeros(600, dtype=bool)
    for r in rules:
        hit |= decision_list._covered(r, x, ["a", "b"])
    assert (hit == bad).mean() > 0.97


def test_classifier_on_held_out_rows(corpus, labels):
    out = quality_mil.classify(corpus, labels).collect()
    assert len(out) == corpus.count()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    for r in out:
        assert r["held_out"] == (brute.crc(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50
    assert np.mean([p == t for p, t in held]) > 0.93


def test_classifier_edge_rows(dirty, empty, labels):
    constant = quality_mil.classify(dirty, labels.limit(0)).collect()
    assert len(constant) == len(DIRTY) and {r["score"] for r in constant} == {0.5}
    model = quality_mil.GatedAttention()
    scores = quality_mil.score_documents(dirty, model).collect()
    assert all(np.isfinite(r["score"]) for r in scores)
    assert quality_mil.score_documents(empty, model).count() == 0


def test_gradients_match_differences():
    r = np.random.default_rng(3)
    model = quality_mil.GatedAttention()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, edges, y = r.random((7, quality_mil.FEATURES)), np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(s := model.forward(x, edges)[0]) + (1 - y) * np.log(1 - s))
    grads = model.gradients(x, edges, y)
    for k, p in model.p.items():
        at = np.unravel_index(r.integers(p.size), p.shape)
        p[at] += 1e-5
        up = loss()
        p[at] -= 2e-5
        down = loss()
        p[at] += 1e-5
        assert grads[k][at] == pytest.approx((up - down) / 2e-5, rel=2e-3, abs=1e-6)


def test_the_sample_is_bounded_in_rows(spark):
    """Rows that share a doc_id are one of the sample, whatever they are many."""
    from graphwright.llm.labelled import labelled_sample

    documents = spark.range(3000).selectExpr("id % 3 as doc_id", "concat('text ', cast(id as string)) as text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)] + [(0, 1)], "doc_id long, quality int")
    found = sorted(tuple(r) for r in labelled_sample(documents, labels, 5).collect())
    assert found == [(0, "text 0", 1), (1, "text 1", 1), (2, "text 1001", 0)]
    assert labelled_sample(documents, labels, 2).count() == 2
