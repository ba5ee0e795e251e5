import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from graphwright.llm import simhash_bk, similar, textbatch
from graphwright.llm.textbatch import Words

from . import brute
from .conftest import DIRTY


def copies(seed=3, groups=12, size=14, words=220):
    """Groups of texts; members differ from their original in few words (similarity 0.87 or more), groups in all."""
    r, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{r.randrange(10**6)}" for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for at in r.sample(range(words), r.randrange(0, 2)):
                own[at] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(own), g))
    return rows


@pytest.mark.parametrize("tree_size", [4096, 5])
def test_groups_of_near_copies(spark, tree_size):
    rows = copies()
    df = spark.createDataFrame(rows, "doc_id long, text string, g int").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_groups(df, tree_size=tree_size).collect()}
    assert got == {d: g * 14 for d, _, g in rows}


def thue_morse(n=2048, letters="ab"):
    """A sequence and its complement, whose polynomial hashes modulo a power of two agree."""
    one = "".join(letters[i.bit_count() % 2] for i in range(n))
    return one, one.translate(str.maketrans(letters, letters[::-1]))


def test_words_and_texts_that_a_polynomial_confuses(spark):
    one, two = thue_morse()
    spaced = [" ".join(x) for x in (one, two)]
    a, b = Words(pa.array([one + " " + two])).hashes()
    assert a != b and len(set(Words(pa.array(spaced)).digests())) == 2
    kept = similar.keep_first(spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2]


def test_large_shards_lose_no_link(spark):
    """One shard of many texts: chains of near copies whose ends are far apart, cut into pieces of three."""
    r, rows = random.Random(11), []
    for g in range(3):
        base = [f"w{r.randrange(10**6)}" for _ in range(300)]
        for step in range(14):
            base[20 * step] = f"x{r.randrange(10**6)}"
            rows.append((100 * g + step, " ".join(base)))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in similar.similar_groups(df, tree_size=3).collect()}
    ids = sorted(d for d, _ in rows)
    expected = brute.similar_groups([dict(rows)[d] for d in ids])
    assert got == {d: ids[k] for d, k in zip(ids, expected)}


def test_half_changed_texts_stay_apart(spark):
    base = [f"w{i}" for i in range(200)]
    other = base[:100] + [f"v{i}" for i in range(100)]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(base).upper() + "  "), (4, "short text")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in similar.similar_groups(df).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}


def test_edge_rows(dirty, empty):
    dirty = dirty.selectExpr("*", "'k' as _kept", "1L as _kept_key", "'t' as _text_key", "0 as component_id", "'c' as copies", "5 as kept")
    kept = similar.keep_first(dirty.unionByName(dirty))
    assert kept.columns == dirty.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 3, 6, 7, 8, 9, 10, 11]
    assert similar.similar_groups(empty).count() == 0
    assert similar.keep_first(empty).count() == 0
    assert len(DIRTY) == 12


def test_signatures_estimate_the_similarity():
    r, rows = random.Random(1), []
    base = [f"w{i}" for i in range(400)]
    for n in (0, 5, 15, 40):
        own = list(base)
        for at in r.sample(range(400), n):
            own[at] = f"y{at}"
        rows.append(own)
    values = similar.signatures(pa.array([" ".join(x) for x in rows]), 5)[2]
    sets = [{tuple(x[i : i + 5]) for i in range(396)} for x in rows]
    for x in (1, 2, 3):
        true = len(sets[0] & sets[x]) / len(sets[0] | sets[x])
        assert (values[0] == values[x]).mean() == pytest.approx(true, abs=0.1)
    assert np.array_equal(values[0], similar.signatures(pa.array([" ".join(base).upper()]), 5)[2][0])


def test_slices_of_batches_are_read_right():
    texts = [f"Some {i} words Of text number {i * i}" for i in range(50)] + [None, ""]
    column = pa.array(texts)
    whole = similar.signatures(column, 5)
    for begin, length in ((0, 7), (7, 20), (27, 25), (50, 2)):
        part = similar.signatures(column.slice(begin, length), 5)
        assert all(np.array_equal(p, w[begin : begin + length]) for p, w in zip(part, whole, strict=True))


def test_similar_texts_with_distant_codes_are_linked(spark):
    r = random.Random(5)
    rows, apart = [], []
    for i in range(20):
        base = [f"w{r.randrange(10**6)}" for _ in range(400)]
        passage = [f"p{r.randrange(10**6)}" for _ in range(40)]
        texts = [" ".join(base), " ".join(base + 8 * passage)]
        a, b = similar.signatures(pa.array(texts), 5)[1]
        apart.append(int(np.bitwise_count(a ^ b)))
        rows += [(2 * i, texts[0]), (2 * i + 1, texts[1])]
    assert max(apart) > similar.RADIUS
    got = {x["doc_id"]: x["component_id"] for x in similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def test_pairs_near_the_threshold_are_decided_exactly(spark):
    r = random.Random(9)
    rows, expected, estimated = [], {}, []
    for i in range(40):
        shared = 1600 + (i % 2) * 12 - 6  # of 2,000 and some shingles in all: 0.797 or 0.803
        base = [f"w{r.randrange(10**9)}" for _ in range(shared + 4)]
        own = [[f"{x}{r.randrange(10**9)}" for _ in range((2000 - shared) // 2)] for x in "ab"]
        texts = [" ".join(base + x) for x in own]
        a, b = ({tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts)
        alike = len(a & b) >= 0.8 * len(a | b)
        values = similar.signatures(pa.array(texts), 5)[2]
        estimated.append(((values[0] == values[1]).mean() >= 0.8, alike))
        rows += [(2 * i, texts[0]), (2 * i + 1, texts[1])]
        expected |= {2 * i: 2 * i, 2 * i + 1: 2 * i + (not alike)}
    assert {(True, False), (False, True)} <= set(estimated)
    got = {x["doc_id"]: x["component_id"] for x in similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected


def test_texts_with_one_doc_id_are_kept_apart(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(200)) for x in "ab")
    rows = [(1, one), (5, one + " more"), (5, two), (5, two.upper()), (7, two + " more")]
    kept = similar.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"].lower()) for r in kept) == [(1, one), (5, two)]


def test_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [None, "", " ", "a b", "a b c d e"] + [" ".join(rng.choice(list("abcdefgh"), k)) + "\n x" for k in rng.integers(0, 400, 20)]
    whole, codes = similar.signatures(pa.array(texts), 5), simhash_bk.simhashes(pa.array(texts), 3)
    for size in (1, 3, 7):
        for module in (textbatch, simhash_bk):
            monkeypatch.setattr(module, "BLOCK", size)
        part = similar.signatures(pa.array(texts), 5)
        assert part[0] == whole[0] and np.array_equal(part[1], whole[1]) and np.array_equal(part[2], whole[2])
        assert np.array_equal(simhash_bk.simhashes(pa.array(texts), 3), codes)


_PEAK = """
import resource, sys
import pyarrow as pa
from graphwright.llm import similar, simhash_bk
line = b" ".join(b"w%d" % i for i in range(99_991)) + b" "
text = pa.array([(line * (50 * 2**20 // len(line) + 1)).decode()])
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
simhash_bk.simhashes(text, 3)
print(peak())
similar.signatures(text, 5)
print(peak())
"""


def test_memory_of_a_text_of_fifty_megabytes():
    found = subprocess.run([sys.executable, "-c", _PEAK], capture_output=True, text=True, check=True)
    assert all(float(x) < 1024 for x in found.stdout.split()), found.stdout
