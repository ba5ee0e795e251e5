import hashlib
import random
import time

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from graphwright.llm import bpe_tree

from .conftest import DIRTY

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABETS = ["abcdefghij", "ab", "a", "thean ingor", "日本語文字列", "éèêçàü", "0123456789", "!?.,-_=", "abc12!é日d́​😀<|>'st\xa0", "aA b\t\n"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def some_texts(n, seed, lengths):
    pick = random.Random(seed)
    texts = ["".join(pick.choices(pick.choice(ALPHABETS), k=pick.choice(lengths))) for _ in range(n)]
    return [t + "<|endoftext|>" + t[:9] if i % 9 == 0 else t for i, t in enumerate(texts)]


def check(df, tokenizer, rows, **settings):
    found = sorted((tuple(r) for r in bpe_tree.encode_digests(df, PATH, **settings).collect()), key=str)
    assert found == sorted(((i, *expected(tokenizer, t)) for i, t in rows), key=str)


@pytest.mark.parametrize("leaf", [1, 2, 5, 24])
def test_trees_encode_as_the_library(tokenizer, leaf):
    encoder = bpe_tree.TreeEncoder(PATH, leaf)
    assert encoder.trees
    for text in some_texts(250, leaf, [1, 7, 40, 300]):
        assert list(memoryview(encoder.encode([text])[0]).cast(encoder.format)) == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_joins_of_any_two_halves(tokenizer):
    encoder, pick = bpe_tree.TreeEncoder(PATH), random.Random(1)
    for _ in range(400):
        word = "".join(pick.choices("etaoinshr", k=pick.randrange(2, 60)))
        at = pick.randrange(1, len(word))
        left, right = encoder._leaf(word[:at], False), encoder._leaf(word[at:], True)
        assert encoder.join(left, right, True) == tokenizer.encode(word, add_special_tokens=False).ids


def test_tokenizers_without_rising_ranks_are_left_to_the_library():
    encoder = bpe_tree.TreeEncoder(PATH)
    model = {"end_of_word_suffix": "</w>", "dropout": None, "continuing_subword_prefix": None, "byte_fallback": False, "merges": [["ab", "c"], ["a", "b"]], "vocab": dict.fromkeys(x + y for x in encoder.letters for y in ("", "</w>"))}
    assert not encoder._rising(model) and encoder._rising(model | {"merges": [["a", "b"], ["ab", "c"]]})
    assert not bpe_tree.TreeEncoder(public_tokenizers.path("byte_bpe_50k.json")).trees


def test_documents(documents, rows, tokenizer):
    check(documents, tokenizer, rows)


def test_all_cases(spark, dirty, empty, tokenizer):
    check(dirty.unionByName(dirty), tokenizer, 2 * [(r[0], r[1]) for r in DIRTY])
    assert bpe_tree.encode_digests(empty, PATH).count() == 0


def test_spread_documents_and_blocks(spark, tokenizer):
    """Long runs over the cluster, between blocks of other text; marks in long runs; a text twice."""
    pick = random.Random(4)
    run = lambda n: "".join(pick.choices("etaoinshrdlu", k=n))
    texts = [run(3000), "so it is " * 400 + run(900) + " and\n" + run(137) + "1" * 300 + run(80) + "<|endoftext|>" + run(500), "日本語" * 600 + " x " + "é" * 700, "words only " * 300, "!" * 999, "", None]
    texts += [texts[1]] + some_texts(20, 8, [300, 900])
    rows = list(enumerate(texts)) + [(None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(df, tokenizer, rows, leaf=4, spread=200, block=150, chunk=16)
    check(df, tokenizer, rows, leaf=4, spread=500, block=100, chunk=37)
    check(df, tokenizer, rows)


def test_ids_and_round_trip(spark, documents, rows, tokenizer):
    encoded = bpe_tree.encode_texts(documents, PATH, leaf=4, spread=64, block=100, chunk=16)
    texts = dict(rows)
    for r in encoded.collect():
        assert r["token_ids"] == tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids and r["n_tokens"] == len(r["token_ids"])
    back = {r["doc_id"]: r["text"] for r in bpe_tree.decode_texts(encoded, PATH).collect()}
    assert back == {i: tokenizer.decode(tokenizer.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, t in rows}


def test_other_tokenizer(spark, documents, rows):
    """With a decoder, and split otherwise: whole texts go through the library."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe_tree.encode_digests(documents.limit(40), path).collect()}
    assert found and all(v == expected(other, dict(rows)[k]) for k, v in found.items())


def test_memory_of_a_long_text(tokenizer):
    """Blocks cover a text once, in order, and hold at most `block` bytes where there is white space."""
    data = ("word " * 1000 + "x" * 700 + "\n" + "y" * 90 + " ").encode()
    for spread, block in ((500, 64), (64, 32), (10**6, 64)):
        cuts = bpe_tree._cuts(data, spread, block)
        assert [c[0] for c in cuts] == [0] + [c[1] for c in cuts[:-1]] and cuts[-1][1] == len(data)
        assert all(long_ or e - s <= max(block, 701) for s, e, long_ in cuts)
        assert all(long_ or s == 0 or data[s : s + 1] in b" \n" or data[s - 1 : s] in b" \n" for s, e, long_ in cuts)


def encode_batch(texts):
    """Result and CPU seconds (least of three runs) of one batch, without Spark."""
    seconds = []
    for _ in range(3):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
        begin = time.process_time()
        made = list(bpe_tree._encode(iter([batch]), PATH, bpe_tree.DIGEST, bpe_tree.LEAF, bpe_tree.SPREAD_BYTES, bpe_tree.BLOCK_BYTES, bpe_tree.CHUNK_LETTERS))
        seconds.append(time.process_time() - begin)
    rows = [r for b in made for r in b.to_pylist()]
    return {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows}, min(seconds)


def test_long_texts_cost_about_what_short_ones_do(tokenizer):
    """The same words as short texts, texts of one block, and one text of several blocks: no token becomes a Python object."""
    pick = random.Random(5)
    words = ["".join(pick.choices("etaoinshrdlu", k=pick.randrange(2, 9))) for _ in range(2000)]
    text = " ".join(pick.choices(words, k=300_000))
    cut = lambda n: [text[at : at + n] for at in range(0, len(text), n)]
    short, middle, long_ = cut(2000), cut(60_000), [text]
    assert len(text) > bpe_tree.BLOCK_BYTES
    found = {}
    for name, texts in (("short", short), ("middle", middle), ("long", long_)):
        made, found[name] = encode_batch(texts)
        assert all(made[i] == expected(tokenizer, t) for i, t in enumerate(texts))
    assert found["middle"] < 1.7 * found["short"] and found["long"] < 1.7 * found["short"], found


def test_texts_of_one_block_are_encoded_together(monkeypatch):
    """Texts beyond SPREAD_BYTES / 4 letters without long runs are no calls of their own; those with a long run are set apart."""
    calls, encoder = [], bpe_tree.encoder_of(PATH, bpe_tree.LEAF)
    monkeypatch.setattr(encoder, "encode", lambda texts, own=encoder.encode: calls.append(len(texts)) or own(texts))
    texts = [f"{i} words of a text " * 1000 for i in range(8)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9), pa.int64()), pa.array([*texts, "so " * 99 + "x" * 40_000])], names=["doc_id", "text"])
    list(bpe_tree._encode(iter([batch]), PATH, bpe_tree.DIGEST, bpe_tree.LEAF, bpe_tree.SPREAD_BYTES, bpe_tree.BLOCK_BYTES, bpe_tree.CHUNK_LETTERS))
    assert calls == [8, 1]
