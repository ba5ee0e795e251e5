import pytest

from graphwright.llm import mixing

from . import brute
from .conftest import DIRTY


def brute_shares(sizes):
    order = sorted(x for x in sizes if x is not None) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        total = sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / total for s in order}
        over = {s for s in order if target[s] > 3 * sizes[s] + 1e-9} - capped
        if not over:
            return target
        capped |= over


def check(df, rows):
    out = df.collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.WORD.findall(t or ""))
    target = brute_shares(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    assert sorted((r["doc_id"], r["size"]) for r in out) == sorted((d, len(brute.WORD.findall(t or ""))) for d, t, _ in rows)
    longest = {s: max(r["size"] for r in out if r["source"] == s) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * longest[s] + 1, s
    assert sum(taken.values()) <= sum(sizes.values())
    return sorted((r["doc_id"], r["taken"]) for r in out)


def test_near_targets_and_repeatable(documents, spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()]
    first = check(mixing.mix_sources(documents), rows)
    assert first == check(mixing.mix_sources(documents.repartition(7)), rows)


def test_edge_rows(dirty, empty):
    check(mixing.mix_sources(dirty), [(r[0], r[1], r[3]) for r in DIRTY])
    assert mixing.mix_sources(empty).count() == 0
    out = mixing.mix_sources(dirty.unionByName(dirty))
    assert out.count() == 2 * len(DIRTY)


def test_shares_reshare_the_excess():
    assert mixing.shares({"a": 10, "b": 1000, None: 100}) == pytest.approx(brute_shares({"a": 10, "b": 1000, None: 100}))
    assert mixing.shares({"a": 0, "b": 8}) == {"a": 0.0, "b": 8.0}
    assert mixing.shares({}) == {}
