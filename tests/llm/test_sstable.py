import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphwright.llm import sstable

from .conftest import DIRTY

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def expected(tokenizer, rows):
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def result(df):
    return sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in df.collect()), key=lambda r: r[1])


def test_round_trip(documents, rows, tokenizer):
    assert result(sstable.encode_documents(documents, PATH)) == expected(tokenizer, rows)


def test_edge_rows(dirty, empty, spark, tokenizer):
    odd = [(None, "no id"), (-5, "a\x0bb\x0cc\x1cd\x85e\xa0f g"), (-6, "é ́x Σas ΣΑΣ ὈΔΥΣΣΕΎΣ\r\n<|startoftext|>a<|endoftext|>b c<|endoftext|>"), (1 << 62, "it's we'LL 'd '"), (12, "\x00 ​"), (13, "x" * 3000)]
    df = spark.createDataFrame(odd, "doc_id long, text string")
    assert result(sstable.encode_documents(df, PATH)) == expected(tokenizer, odd)
    assert result(sstable.encode_documents(dirty, PATH)) == expected(tokenizer, [r[:2] for r in DIRTY])
    assert result(sstable.encode_documents(dirty.unionByName(dirty), PATH)) == expected(tokenizer, 2 * [r[:2] for r in DIRTY])
    assert sstable.encode_documents(empty, PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "É", "'s", "'S", " ", "\n", "\t", "1", "²", "!", "…", "ß", "ĩ", "ı", "İ", "\u0301", "\x1f", "\x7f", "\xa0", "\xad", "ĳ", "<|endoftext|>"]), max_size=40))
def test_encoder_is_the_library(tokenizer, signs):
    text = "".join(signs)
    encoder = sstable.encoder_of(PATH, 1)
    assert np.frombuffer(encoder.encode([text])[0], dtype=encoder.dtype).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_lookup(documents, rows, tokenizer, spark):
    manifest = sstable.write_tables(documents, PATH, shard_bytes=20_000, block_bytes=4096)
    assert manifest.count() > 5
    asked = spark.createDataFrame([(i,) for i in (0, 7, 199, 5000, -3)], "doc_id long")
    found = {r["doc_id"]: r["ids"] for r in sstable.lookup(spark, manifest, asked).collect()}
    texts = dict(rows)
    assert found == {i: [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 1] for i in (0, 7, 199)}
    assert result(sstable.read_tables(manifest)) == expected(tokenizer, rows)


def test_keys_keep_the_order():
    ids = [-(1 << 63), -7, -1, 0, 1, 255, 256, (1 << 63) - 1]
    keys = [sstable.key_of(i) for i in ids]
    assert keys == sorted(keys) and [sstable.id_of(k) for k in keys] == ids
    assert sstable.key_of(None) < keys[0]


def test_tables_are_bounded_and_exact(tokenizer):
    encoder = sstable.TextEncoder(PATH, 1, kept=5)
    for text in ("a b c d", "e f g a b", "one two three four five six seven", "a b c d e f g"):
        assert np.frombuffer(encoder.encode([text])[0], dtype="<u2").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
    assert len(encoder.parts) <= 5 and len(encoder.parts.old) <= 5


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x180), st.sampled_from("'stremvld <|endoftext>ßéÉİıſΣσ\u0301\u00a0\u00ad½²ª日😀 ")), max_size=60))
def test_parts_equal_the_whole_tokenizer(text):
    text = text.encode("utf-8", "ignore").decode()
    whole = sstable.encoder_of(PATH, 1)
    assert np.frombuffer(whole.encode([text])[0], dtype="<u2").tolist() == [*whole.tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_other_tokenizers_encode_whole_texts(rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = sstable.TextEncoder(path, 1)
    assert encoder.pattern is None
    for _, text in rows[:20]:
        assert np.frombuffer(encoder.encode([text])[0], dtype=encoder.dtype).tolist() == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 1]
