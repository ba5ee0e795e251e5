import heapq
import random

import pytest

from graphwright.llm import sharding

from . import brute
from .conftest import DIRTY


def plain(sizes, shards):
    heap, loads = [(0, k) for k in range(shards)], [0] * shards
    for s in sorted(sizes, reverse=True):
        load, k = heapq.heappop(heap)
        loads[k] = load + s
        heapq.heappush(heap, (loads[k], k))
    return loads


@pytest.mark.parametrize("seed", range(6))
def test_quotas_equal_the_plain_heap(seed):
    r = random.Random(seed)
    sizes = [r.choice([8, 9, 50, 400, r.randint(8, 3000)]) for _ in range(r.choice([3, 200, 4000]))]
    histogram = {s: sizes.count(s) for s in set(sizes)}
    loads = [0] * 24
    for size, order, bounds in sharding.lpt_quotas(list(histogram.items()), 24):
        for k, n in zip(order, [b - a for a, b in zip([0, *bounds], bounds)]):
            loads[k] += n * size
    assert loads == plain(sizes, 24)


def check(df, rows, shards):
    out = df.collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == sorted((d, len((t or "").encode()) + 8, brute.crc((t or "").encode())) for d, t in rows)
    text = dict(rows)
    groups, loads, slots = {}, [0] * shards, {}
    for r in out:
        assert groups.setdefault(text[r["doc_id"]] or "", r["shard"]) == r["shard"]
        loads[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = {}
    for _, t in rows:
        sizes[t or ""] = sizes.get(t or "", 0) + len((t or "").encode()) + 8
    assert sorted(loads) == sorted(plain(sizes.values(), shards))


def test_matches_plain_heap(documents, rows):
    check(sharding.shard_documents(documents), rows, 24)


def test_edge_rows(dirty, empty):
    check(sharding.shard_documents(dirty, shards=3), [r[:2] for r in DIRTY], 3)
    assert sharding.shard_documents(empty).count() == 0
    assert sharding.shard_documents(dirty.unionByName(dirty)).count() == 2 * len(DIRTY)


def test_few_classes_at_the_driver(spark, monkeypatch):
    """Far more sizes than classes: the driver sees the classes only, and the loads stay within the stated distance."""
    seen = []
    plan = sharding.lpt_quotas
    monkeypatch.setattr(sharding, "lpt_quotas", lambda histogram, shards: seen.append(len(histogram)) or plan(histogram, shards))
    monkeypatch.setattr(sharding, "EXACT_BITS", 6)
    n = 100_000
    df = spark.range(n).selectExpr("id as doc_id", "concat(cast(id as string), ':', repeat('x', cast(id % 20011 as int))) as text")
    out = sharding.shard_documents(df)
    loads = sorted(r[1] for r in out.groupBy("shard").agg({"size": "sum"}).collect())
    assert len(loads) == 24 and out.count() == n
    assert seen[0] <= 64 + 32 * 10
    assert loads[-1] - loads[0] <= sum(loads) / 24 / 32 + 20_025
