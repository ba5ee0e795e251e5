"""Encoding and decoding with a given BPE tokenizer, long unsplit text by tree concatenation.

A text is split at white space and then by the tokenizer's own pattern; the merges of a piece know nothing of other pieces. A piece longer than
LEAF letters is cut into halves, again and again; the halves are encoded on their own and joined: the last k tokens of the left and the first k of
the right are encoded anew, for k = 1, 2, 4, ..., until the first token of the window is the left's and the last one the right's (or the window
has reached the piece's end). Then every two neighbours stand as they do in an encoding of their own, and as merges are made in the order of their
ranks and reach only neighbours, the whole is the encoding of the whole. This needs ranks that rise (each merge joins letters or what earlier
merges made) and a vocabulary with all letters; other tokenizers encode whole texts through the library (`TreeEncoder.trees`).

Within a task pieces up to SPREAD_BYTES are halved in turn. Runs beyond SPREAD_BYTES without white space are spread over the cluster: their chunks are
encoded in parallel, and each level of the tree joins neighbours after one shuffle of these documents alone. No other document is shuffled.

Cases: null text is an empty one, of no tokens; texts longer than BLOCK_BYTES are encoded and hashed block by block, cut at white space; repeated
rows give a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sstable import TextEncoder
from .storage import materialize
from .textbatch import give_back, pieces

LEAF = 24
SPREAD_BYTES = 32 << 10
BLOCK_BYTES = 1 << 20
BATCH_BYTES = 2 << 20
CHUNK_LETTERS = 16 << 10
JOINED_IDS = 1 << 16
IS_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: Where a run of normalized text can be cut for the splitting pattern: after a digit, which is a piece of its own, and before what ends a run of letters.
SAFE_CUT = re.compile(r"(?<=[0-9])|(?<=[a-z])(?=[!-/:-@\[-`{-~])")
ROWS = "doc_id long, doc string, seq long, node long, nodes long, ends boolean, letters string, ids binary, n_tokens long, {}"
DIGEST = "ids_sha256 string, decoded_sha256 string"
LISTS = "token_ids array<int>"
TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


class TreeEncoder(TextEncoder):
    """TextEncoder without an end id, whose long pieces are encoded as trees. trees: whether the tokenizer allows that."""

    def __init__(self, tokenizer_path: str, leaf: int = LEAF):
        super().__init__(tokenizer_path, 0)
        self.end, self.leaf = b"", leaf
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        made = json.loads(self.tokenizer.to_str())
        self.trees = self.pattern is not None and self._rising(made["model"])
        self.names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.spaced = made.get("decoder") is None  # then decoding puts a space between tokens
        if self.trees:
            from tokenizers import models

            own = made["model"]
            self.suffix = own["end_of_word_suffix"] or ""
            self.bare = models.BPE(own["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in own["merges"]], cache_capacity=1000)
            self.mark = re.compile("|".join(map(re.escape, sorted(self.marks, key=len, reverse=True)))) if self.marks else None

    def _rising(self, model: dict) -> bool:
        suffix = model["end_of_word_suffix"] or ""
        if model["dropout"] or model["continuing_subword_prefix"] or model["byte_fallback"] or model.get("ignore_merges"):
            return False
        made = {x + y for x in self.letters for y in ("", suffix)}
        if not made <= model["vocab"].keys():
            return False
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            if a not in made or b not in made or (suffix and a.endswith(suffix)):
                return False
            made.add(a + b)
        return True

    def _leaf(self, letters: str, ends: bool) -> list[int]:
        return [t.id for t in (self.model if ends else self.bare).tokenize(letters)]

    def tree(self, letters: str, ends: bool = True) -> list[int]:
        """Ids of a piece (as letters); ends: whether the piece ends here, or goes on."""
        level = [letters]
        while len(level[0]) > self.leaf:  # halves differ by a letter at most
            level = [half for x in level for half in (x[: len(x) // 2], x[len(x) // 2 :])]
        found = [self._leaf(x, ends and i == len(level) - 1) for i, x in enumerate(level)]
        while len(found) > 1:
            found = [self.join(found[i], found[i + 1], ends and i + 2 == len(found)) for i in range(0, len(found), 2)]
        return found[0]

    def join(self, left: list[int], right: list[int], ends: bool) -> list[int]:
        """The encoding of two texts' concatenation from their encodings; ends: whether the piece ends with right."""
        k = 1
        while True:
            a, b = left[-k:], right[:k]
            last = ends and k >= len(right)
            text = "".join([self.names[i] for i in a + b])
            new = self._leaf(text.removesuffix(self.suffix) if last else text, last)
            if (k >= len(left) or new[0] == a[0]) and (k >= len(right) or new[-1] == b[-1]):
                return left[:-k] + new + right[k:]
            k *= 2

    def _piece(self, piece: str) -> bytes:
        if not self.trees or len(piece) <= self.leaf:
            return super()._piece(piece)
        return self._bytes(self.tree("".join([self.letters[b] for b in piece.encode()])))

    def _part(self, part: bytes) -> bytes:
        if not self.trees or len(part) <= self.leaf or self._is_plain(text := part.decode()):
            return super()._part(part)
        return b"".join([x if isinstance(x, bytes) else self._bytes(self.tree(x)) for x in self.run(text)])

    def run(self, text: str) -> Iterator[bytes | str]:
        """Text without ASCII white space as ids of marks and letters of pieces."""
        at = 0
        for m in self.mark.finditer(text) if self.mark else ():
            yield from self._letters(text[at : m.start()])
            yield self._bytes([self.tokenizer.token_to_id(m[0])])
            at = m.end()
        yield from self._letters(text[at:])

    def _letters(self, text: str) -> Iterator[str]:
        text, at = self.tokenizer.normalizer.normalize_str(text) if text else "", 0
        while at < len(text):  # the library's list of pieces stays short
            cut = SAFE_CUT.search(text, at + (1 << 16))
            end = cut.start() if cut else len(text)
            for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text[at:end]):
                yield piece
            at = end


@functools.lru_cache(maxsize=2)
def encoder_of(tokenizer_path: str, leaf: int) -> TreeEncoder:
    """One encoder for each worker process, so its tables last over tasks."""
    return TreeEncoder(tokenizer_path, leaf)


class Digests:
    """Hashes of the ids and of the decoded text of many documents, or of one that comes block by block."""

    def __init__(self, encoder: TreeEncoder):
        self.encoder = encoder
        self.decimal = pa.array(map(str, range(len(encoder.names))), pa.string())
        self.names = pa.array(encoder.names, pa.string())

    def of(self, ids: list[bytes]) -> list[tuple]:
        """(n_tokens, ids_sha256, decoded_sha256) of each."""
        width = self.encoder.dtype.itemsize
        flat = np.frombuffer(b"".join(ids), dtype=self.encoder.dtype)
        offsets = np.concatenate(([0], np.cumsum([len(x) // width for x in ids])))
        numbers = [hashlib.sha256(x).hexdigest() for x in self.joined(self.decimal, flat, offsets)]
        if self.encoder.spaced:
            texts = [hashlib.sha256(x).hexdigest() for x in self.joined(self.names, flat, offsets)]
        else:
            texts = [hashlib.sha256(self.decode(x).encode()).hexdigest() for x in ids]
        return [(len(x) // width, n, t) for x, n, t in zip(ids, numbers, texts)]

    def joined(self, words: pa.Array, flat: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The words of flat[s:e] with a space between them, for every two neighbouring offsets; Arrow does it, not Python token by token."""
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), words.take(pa.array(flat.astype(np.int32))))
        return pa.compute.binary_join(lists, " ").cast(pa.binary()).to_pylist()

    def decode(self, ids: bytes) -> str:
        return self.encoder.tokenizer.decode(np.frombuffer(ids, dtype=self.encoder.dtype).tolist(), skip_special_tokens=False)

    def blocks(self, ids: Iterator[bytes]) -> tuple:
        """The same of one document's blocks of ids, in order."""
        n, numbers, texts, whole = 0, hashlib.sha256(), hashlib.sha256(), []
        for block in ids:
            if not self.encoder.spaced:
                whole.append(block)
            flat = np.frombuffer(block, dtype=self.encoder.dtype)
            for at in range(0, len(flat), JOINED_IDS):
                own = flat[at : at + JOINED_IDS]
                for digest, words in ((numbers, self.decimal), (texts, self.names)):
                    if n:
                        digest.update(b" ")
                    digest.update(*self.joined(words, own, np.array([0, len(own)])))
                n += len(own)
        if not self.encoder.spaced:
            texts = hashlib.sha256(self.decode(b"".join(whole)).encode())
        return n, numbers.hexdigest(), texts.hexdigest()


class Lists:
    """Token ids themselves, in place of their hashes."""

    def __init__(self, encoder: TreeEncoder):
        self.encoder = encoder

    def of(self, ids: list[bytes]) -> list[tuple]:
        return [self.blocks(iter([x])) for x in ids]

    def blocks(self, ids: Iterator[bytes]) -> tuple:
        own = np.frombuffer(b"".join(ids), dtype=self.encoder.dtype).astype(np.int32)
        return len(own), own


def _result(encoder: TreeEncoder, columns: str) -> Digests | Lists:
    return Digests(encoder) if columns == DIGEST else Lists(encoder)


def _cuts(data: bytes, spread: int, block: int) -> list[tuple[int, int, bool]]:
    """(start, end, is a long run) of the parts of a text: white-space-free runs of more than `spread` bytes, and blocks of what lies between."""
    space = np.flatnonzero(IS_SPACE[np.frombuffer(data, dtype=np.uint8)])
    edges = np.concatenate(([-1], space, [len(data)]))
    out, at = [], 0
    for i in np.flatnonzero(np.diff(edges) - 1 > spread).tolist():
        out += _blocks(edges, at, int(edges[i]) + 1, block)
        out.append((int(edges[i]) + 1, int(edges[i + 1]), True))
        at = int(edges[i + 1])
    return out + _blocks(edges, at, len(data), block)


def _blocks(edges: np.ndarray, start: int, end: int, block: int) -> list[tuple[int, int, bool]]:
    out = []
    while start < end:
        cut = end if end - start <= block else int(edges[max(np.searchsorted(edges, start + block, "right") - 1, np.searchsorted(edges, start, "right"))])
        cut = min(max(cut, start + 1), end)
        out.append((start, cut, False))
        start = cut
    return out


def _rows(found: list[dict], columns: str) -> pa.RecordBatch:
    fields = [f.split() for f in ROWS.format(columns).split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in found], TYPES[k]) for n, k in fields], names=[n for n, _ in fields])


def _encode(batches: Iterator[pa.RecordBatch], tokenizer_path: str, columns: str, leaf: int, spread: int, block: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """Whole documents with their result (seq is null), and the parts of those that are spread."""
    encoder, names = encoder_of(tokenizer_path, leaf), [f.split()[0] for f in columns.split(", ")]
    result = _result(encoder, columns)
    row = lambda doc_id, made: {"doc_id": doc_id, **dict(zip(["n_tokens", *names], made))}
    for piece in pieces(batches, limit=BATCH_BYTES):
        ids, texts = piece.column(0).to_pylist(), piece.column(1).to_pylist()
        plain, apart = [], []  # apart: texts of several blocks, or with long runs
        for i, t in enumerate(texts):
            if 4 * len(t) <= spread or not encoder.trees and len(t) <= block:
                plain.append(i)
                continue
            data = t.encode()
            parts = _cuts(data, spread, block) if encoder.trees else [(0, len(data), False)]
            if encoder.trees and [long_ for *_, long_ in parts] == [False]:
                plain.append(i)
            else:
                apart.append((i, data, parts))
        made = encoder.encode([texts[i] for i in plain])
        out = [row(ids[i], x) for i, x in zip(plain, result.of(made))]
        for i, data, parts in apart:
            if not any(long_ for *_, long_ in parts):
                out.append(row(ids[i], result.blocks(encoder.encode([data[s:e].decode()])[0] for s, e, _ in parts)))
                continue
            # A document with long runs: its parts, under a name of its own.
            seq, name = 0, uuid.uuid4().hex
            for s, e, long_ in parts:
                ready = bytearray() if long_ else encoder.encode([data[s:e].decode()])[0]
                for x in encoder.run(data[s:e].decode()) if long_ else ():
                    if isinstance(x, bytes) or len(x) <= chunk:
                        ready += x if isinstance(x, bytes) else encoder._bytes(encoder.tree(x))
                        continue
                    if ready:
                        out.append({"doc_id": ids[i], "doc": name, "seq": seq, "ids": bytes(ready)})
                        seq, ready = seq + 1, bytearray()
                    n = -(-len(x) // chunk)
                    for k in range(n):
                        out.append({"doc_id": ids[i], "doc": name, "seq": seq, "node": k, "nodes": n, "ends": k == n - 1, "letters": x[k * chunk : (k + 1) * chunk]})
                    seq += 1
                    if n > 16:
                        yield _rows(out, columns)
                        out = []
                if ready:
                    out.append({"doc_id": ids[i], "doc": name, "seq": seq, "ids": bytes(ready)})
                    seq += 1
        yield _rows(out, columns)
    give_back()


def _leaves(batches: Iterator[pa.RecordBatch], tokenizer_path: str, columns: str, leaf: int) -> Iterator[pa.RecordBatch]:
    encoder = encoder_of(tokenizer_path, leaf)
    for batch in batches:
        for r in batch.to_pylist():
            yield _rows([r | {"letters": None, "ids": encoder._bytes(encoder.tree(r["letters"], r["ends"]))}], columns)


def _level(batches: Iterator[pa.RecordBatch], tokenizer_path: str, columns: str, leaf: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring nodes, which follow each other, joined to one."""
    encoder, left = encoder_of(tokenizer_path, leaf), None
    up = lambda r, ids, ends: _rows([r | {"node": r["node"] // 2, "nodes": (r["nodes"] + 1) // 2, "ids": ids, "ends": ends}], columns)
    read = lambda r: np.frombuffer(r["ids"], dtype=encoder.dtype).tolist()
    for batch in batches:
        for r in batch.to_pylist():
            if r["node"] % 2 == 0 and r["node"] + 1 < r["nodes"]:
                left = r
            elif r["node"] % 2 == 0:
                yield up(r, r["ids"], r["ends"])
            else:
                yield up(left, encoder._bytes(encoder.join(read(left), read(r), r["ends"])), r["ends"])


def _collect(batches: Iterator[pa.RecordBatch], tokenizer_path: str, columns: str, leaf: int) -> Iterator[pa.RecordBatch]:
    """Documents from their parts in order."""
    result, names = _result(encoder_of(tokenizer_path, leaf), columns), [f.split()[0] for f in columns.split(", ")]
    rows = (r for batch in batches for r in batch.to_pylist())
    ahead = next(rows, None)
    while ahead is not None:
        first = ahead

        def own(first: dict = first) -> Iterator[bytes]:
            nonlocal ahead
            while ahead is not None and ahead["doc"] == first["doc"]:
                yield ahead["ids"]
                ahead = next(rows, None)

        yield _rows([{"doc_id": first["doc_id"], **dict(zip(["n_tokens", *names], result.blocks(own())))}], columns)


def _run(documents: DataFrame, tokenizer_path: str, columns: str, leaf: int, spread: int, block: int, chunk: int) -> DataFrame:
    schema, of = ROWS.format(columns), {"tokenizer_path": tokenizer_path, "columns": columns, "leaf": leaf}
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    made = materialize(rows.mapInArrow(functools.partial(_encode, spread=spread, block=block, chunk=chunk, **of), schema), "bpe-rows")
    names = [f.split()[0] for f in columns.split(", ")]
    whole = made.filter("seq is null").select("doc_id", "n_tokens", *names)
    deepest = made.agg(F.max("nodes").alias("nodes"), F.count("seq").alias("parts")).head()
    if not deepest["parts"]:
        return whole
    nodes, parts = deepest["nodes"] or 0, made.filter("seq is not null")
    level = parts.filter("nodes is not null").repartition("doc", "seq", "node").mapInArrow(functools.partial(_leaves, **of), schema)
    while nodes > 1:
        pair = [F.col("doc"), F.col("seq"), F.expr("node div 2")]
        level = level.repartition(*pair).sortWithinPartitions("doc", "seq", "node").mapInArrow(functools.partial(_level, **of), schema)
        nodes = (nodes + 1) // 2
    ready = parts.filter("nodes is null").unionByName(level).repartition("doc").sortWithinPartitions("doc", "seq")
    return whole.unionByName(ready.mapInArrow(functools.partial(_collect, **of), schema).select("doc_id", "n_tokens", *names))


def encode_digests(documents: DataFrame, tokenizer_path: str, leaf: int = LEAF, spread: int = SPREAD_BYTES, block: int = BLOCK_BYTES, chunk: int = CHUNK_LETTERS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space) and decoded_sha256 (UTF-8 of the decoded text) of every row."""
    return _run(documents, tokenizer_path, DIGEST, leaf, spread, block, chunk)


def encode_texts(documents: DataFrame, tokenizer_path: str, leaf: int = LEAF, spread: int = SPREAD_BYTES, block: int = BLOCK_BYTES, chunk: int = CHUNK_LETTERS) -> DataFrame:
    """doc_id, n_tokens and token_ids of every row."""
    return _run(documents, tokenizer_path, LISTS, leaf, spread, block, chunk)


def decode_texts(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """encoded (with doc_id and token_ids) as doc_id and text, as the library decodes without skipping special tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder_of(tokenizer_path, LEAF).tokenizer
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([tokenizer.decode(ids or [], skip_special_tokens=False)], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")
