import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from graphwright.llm import oracle, prefix_trie
from graphwright.llm.radix import Tree

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    held = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        if c is not None:
            held[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], text))
    own = {c: [(role, text) for _, _, role, _, text in sorted(v)] for c, v in held.items()}
    new = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        new[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:])
    members, kids = defaultdict(list), defaultdict(list)
    for c, v in new.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(new[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(df, **settings):
    trie = prefix_trie.build_trie(prefix_trie.rebuilt(prefix_trie.ordered_turns(df)), **settings)
    found = sorted((tuple(r) for r in trie.collect()), key=str)
    assert found == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    return found


@pytest.fixture(scope="module")
def conversations(spark):
    pick = random.Random(5)
    rows = [(c, pick.choice([t, t, None]), pick.choice(["user", "assistant", None]), pick.choice(["hi", "yes", "", None, "é日" * 3])) for c in range(-150, 400) for t in range(pick.choice([1, 2, 3, 6, 40]))]
    rows += [(c, t, "user", "the same") for c in range(1000, 1250) for t in range(3)]  # whole conversations, again and again
    rows += [(None, 0, "user", "nobody's"), (7, 0, "user", "hi"), (7, 0, "user", "hi"), (9223372036854775807, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as node", "1 as depth", "'k' as key", "0 as part").repartition(5)


def test_real_conversations(spark, small):
    assert check(spark.read.parquet(f"{small}/conversations.parquet"))


def test_all_cases_in_small_runs(spark, conversations):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(conversations, run_keys=3, chunk_bytes=8, fan=2)
        check(conversations, run_keys=1, chunk_bytes=1 << 20, fan=3)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    check(conversations)


def test_joined_parents(conversations, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BROADCAST_ROWS", 0)
    check(conversations)


def test_turnless_and_empty(spark, conversations):
    lonely = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6)
    found = check(spark.createDataFrame([(lonely, 0, "user", "gone with its century")], SCHEMA))
    assert found == [(lonely, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lonely).encode()).hexdigest())]
    assert prefix_trie.conversation_trie(conversations.limit(0)).count() == 0


def test_sql_agrees(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{small}/conversations.parquet')")
    expected = sorted(con.execute(oracle.PREFIX_TRIE).fetchall(), key=str)
    assert sorted((tuple(r) for r in prefix_trie.conversation_trie(spark.read.parquet(f"{small}/conversations.parquet")).collect()), key=str) == expected


def test_radix_tree_layouts():
    pick, keys = random.Random(2), set()
    for i, n in enumerate((1, 3, 9, 30, 200, 256)):  # children of one node: all layouts
        keys |= {bytes([i]) + bytes([b, 0, 7]) for b in pick.sample(range(256), n)}
    keys |= {b"", bytes(8), bytes(12), b"\xff" * 4000, b"\xff" * 2000 + bytes(4)}
    tree, order = Tree(), list(keys)
    pick.shuffle(order)
    for k in order:
        tree.insert(k, k)
    tree.insert(bytes(8), "new")
    found, parents = [], []
    for depth, parent, value in tree.walk(4):
        parents.append((depth, parent))
        found += [value] if value is not None else []
    assert found == [("new" if k == bytes(8) else k) for k in sorted(keys)]
    assert len(parents) == len({k[:n] for k in keys for n in range(0, len(k) + 1, 4)})
    assert all(parents[p][0] == d - 1 for d, p in parents if d)
