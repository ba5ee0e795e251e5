"""Token ids of documents in sorted-string-table shards.

A shard file holds documents by ascending doc_id:
  blocks   zstd-compressed; entries (shared, suffix, value: lengths as u16, u16, u32), the key's suffix, the ids.
           Keys are 8 bytes, big-endian with the sign bit flipped (empty for a null doc_id), and share
           a prefix with the key before them in the block; ids are u16, or u32 if the vocabulary needs it.
  index    for each block: first key (u8 length and 8 bytes), offset u64, stored length u32, raw length u32.
  bloom    k (u8) and the bits of a Bloom filter over the keys.
  footer   fixed size: offsets and lengths of index and bloom, documents, ids, width, format mark.
A search reads the footer, asks the Bloom filter, finds the block in the sparse index by bisection, and reads that block.

Spark range-partitions the documents by doc_id; each task tokenizes and writes its files into the shared folder,
named after the task attempt, and returns manifest rows. Only files in the manifest count, so a task that is run again
or twice does no harm. Encoded words are kept in bounded tables, one set for each worker process
(TextEncoder says when that is exact).

Cases: null text is an empty one (just the end id); null doc_ids come first; rows with equal doc_id are neighbours, ordered by
text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import regex
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import fresh_path, materialize
from .textbatch import mix, pieces

MARK = b"GWSSTv1\n"
FOOTER = struct.Struct("<QQQQQQB8s")
ENTRY = struct.Struct("<HHI")
INDEX = struct.Struct("<B8sQII")
BLOCK_BYTES = 256 << 10
SHARD_BYTES = 64 << 20
CACHED_PIECES = 250_000
ENCODED_BYTES = 4 << 20
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7
#: The split pattern for which tokens are known never to cross white space, and which covers everything but white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Its other alternatives: set off by spaces, they leave the letters' runs between them.
NO_LETTERS = WORD_PATTERN.replace(r"|[\p{L}]+", "")
#: Texts of tabs, line ends and printable characters below U+0130 only: NFC leaves them alone, and lower case is plain.
PLAIN = re.compile(r"[\t\n\f\r\x20-\x7E\xA1-\xAC\xAE-\u012F]*")
MANIFEST = "part int, seq int, file string, n_docs long, n_tokens long, first_key binary, last_key binary"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) % (1 << 64))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: itself where printable, else the next one from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class _Recent(dict):
    """A table of what was encoded lately: when it is full it becomes the old one, from which entries come back when they are used."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.encode(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class TextEncoder:
    """Encodes texts; the result is that of the library for the whole text.

    If the tokenizer drops white space and splits by WORD_PATTERN (normalizer NFC, white space to one space, lower case; split,
    then byte level), PLAIN texts are split by Arrow, a batch at once; each distinct piece of the batch is given to the library's
    model, unless it is in a bounded table of recent ones, and the texts' ids are gathered from the pieces'. No token crosses ASCII
    white space, so in other texts the parts between it are encoded alone: plain ones likewise, all others by the whole tokenizer.
    Other tokenizers encode whole texts.
    """

    def __init__(self, tokenizer_path: str, end_id: int, kept: int = CACHED_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16 else "<u4")
        self.format = "H" if self.dtype.itemsize == 2 else "I"
        self.end = self._bytes([end_id])
        self.pattern, self.model = self._word_pattern(), self.tokenizer.model
        self.letters = _byte_letters()
        self.pieces = _Recent(self._piece, kept)
        self.parts = _Recent(self._part, kept // 4)

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.format}", *ids)

    def _word_pattern(self):
        made = json.loads(self.tokenizer.to_str())
        steps = (made.get("normalizer") or {}).get("normalizers", [])
        splits = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
        kinds = [x["type"] for x in steps], [x["type"] for x in splits], made["model"]["type"]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], "BPE") or steps[1]["pattern"] != {"Regex": "\\s+"} or steps[1]["content"] != " ":
            return None
        if splits[0]["behavior"] != "Removed" or not splits[0]["invert"] or splits[1]["add_prefix_space"] or splits[1].get("use_regex", True) or any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in made["added_tokens"]):
            return None
        self.marks = [x["content"] for x in made["added_tokens"]]
        if any(m.split() != [m] for m in self.marks):
            return None
        return regex.compile(WORD_PATTERN) if splits[0]["pattern"] == {"Regex": WORD_PATTERN} else None

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = "".join([self.letters[b] for b in piece.encode()])
        return self._bytes([t.id for t in self.model.tokenize(piece)])

    def _is_plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not any(m in text for m in self.marks)

    def _part(self, part: bytes) -> bytes:
        text = part.decode()
        if self._is_plain(text):
            return b"".join([self.pieces[p] for p in self.pattern.findall(text.lower())])
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _plain_texts(self, texts: list[str]) -> list[bytes]:
        spaced = pa.compute.replace_substring_regex(pa.compute.utf8_lower(pa.array(texts, pa.large_string())), NO_LETTERS, r" \0 ")
        lists = pa.compute.ascii_split_whitespace(spaced)
        split = lists.flatten()
        real = pa.compute.not_equal(split, "")  # white space at an end leaves an empty string
        coded = split.filter(real).dictionary_encode()
        pieces = self.pieces
        made = [pieces[p] for p in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        sizes = np.fromiter(map(len, made), dtype=np.int64, count=len(made)) // self.dtype.itemsize
        begins = np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes[which])
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[which] - (ends - sizes[which]), sizes[which])
        ids = np.frombuffer(b"".join(made), dtype=self.dtype)[places]
        before = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
        upto = np.concatenate(([0], ends))[before[lists.offsets.to_numpy()]].tolist()
        return [ids[s:e].tobytes() + self.end for s, e in zip(upto, upto[1:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        if self.pattern is None:
            return [self._bytes(e.ids) + self.end for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        out: list[bytes] = [b""] * len(texts)
        plain = [i for i, t in enumerate(texts) if self._is_plain(t)]
        for i, made in zip(plain, self._plain_texts([texts[i] for i in plain])):
            out[i] = made
        parts = self.parts
        for i in set(range(len(texts))).difference(plain):
            out[i] = b"".join([parts[w] for w in texts[i].encode().split()]) + self.end
        return out


@functools.lru_cache(maxsize=2)
def encoder_of(tokenizer_path: str, end_id: int) -> TextEncoder:
    """One encoder for each worker process, so its tables last over tasks."""
    return TextEncoder(tokenizer_path, end_id)


class ShardWriter:
    def __init__(self, out, width: int, block_bytes: int = BLOCK_BYTES):
        self.out, self.width, self.block_bytes, self.at, self.docs, self.tokens = out, width, block_bytes, 0, 0, 0
        self.block, self.size, self.first, self.last = [], 0, None, b""
        self.index, self.hashes, self.first_key, self.last_key = [], [], None, None
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: bytes) -> None:
        if self.first is None:
            self.first, self.last = key, b""
        shared = len(os.path.commonprefix([self.last, key]))
        self.block += [ENTRY.pack(shared, len(key) - shared, len(ids)), key[shared:], ids]
        self.size += ENTRY.size + len(key) - shared + len(ids)
        self.last = key
        self.docs += 1
        self.tokens += len(ids) // self.width
        self.hashes.append(int.from_bytes(key, "big") if key else (1 << 64) - 1)
        self.first_key, self.last_key = key if self.first_key is None else self.first_key, key
        if self.size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.pack.compress(b"".join(self.block))
            self.out.write(data)
            self.index.append(INDEX.pack(len(self.first), self.first.ljust(8, b"\0"), self.at, len(data), self.size))
            self.at += len(data)
            self.block, self.size, self.first = [], 0, None

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index)
        cells = max(64, BLOOM_BITS_PER_KEY * len(self.hashes))
        flags = np.zeros(-(-cells // 8) * 8, dtype=bool)
        for k in range(BLOOM_HASHES):
            flags[_places(np.array(self.hashes, dtype=np.uint64), k, len(flags))] = True
        bloom = bytes([BLOOM_HASHES]) + np.packbits(flags, bitorder="little").tobytes()
        self.out.write(index + bloom + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.docs, self.tokens, self.width, MARK))
        self.out.close()


def _places(hashes: np.ndarray, turn: int, cells: int) -> np.ndarray:
    return (mix(hashes + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(cells)).astype(np.int64)


class ShardReader:
    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        at, n, bloom_at, bloom_n, self.docs, self.tokens, self.width, mark = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if mark != MARK:
            raise ValueError(f"not a shard file: {uri}")
        self.bloom = self.file.read_at(bloom_n, bloom_at)
        self.index = [(key[:k], at, stored, raw) for k, key, at, stored, raw in INDEX.iter_unpack(self.file.read_at(n, at))]
        self.unpack = zstandard.ZstdDecompressor()

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, stored, raw = self.index[i]
        data, place, key = self.unpack.decompress(self.file.read_at(stored, at), max_output_size=raw), 0, b""
        while place < len(data):
            shared, suffix, size = ENTRY.unpack_from(data, place)
            place += ENTRY.size
            key = key[:shared] + data[place : place + suffix]
            yield key, data[place + suffix : place + suffix + size]
            place += suffix + size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def may_have(self, key: bytes) -> bool:
        own = np.array([int.from_bytes(key, "big") if key else (1 << 64) - 1], dtype=np.uint64)
        flags = np.frombuffer(self.bloom, dtype=np.uint8, offset=1)
        return all(flags[p >> 3] >> (p & 7) & 1 for k in range(self.bloom[0]) for p in _places(own, k, 8 * len(flags)).tolist())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this doc_id."""
        key, found = key_of(doc_id), []
        if not self.index or not self.may_have(key):
            return found
        at = max(0, bisect.bisect_left([x[0] for x in self.index], key) - 1)
        while at < len(self.index) and self.index[at][0] <= key:
            found += [ids for k, ids in self.block(at) if k == key]
            at += 1
        return [np.frombuffer(ids, dtype=f"<u{self.width}") for ids in found]


def write_tables(documents: DataFrame, tokenizer_path: str, end_id: int = 1, path: str | None = None, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write the shards under path (default: a new folder in the shared one) and return the manifest, one row for each file."""
    spark = documents.sparkSession
    path = path or fresh_path(spark, "token-tables")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encoder, done, writer, name = TaskContext.get(), encoder_of(tokenizer_path, end_id), [], None, ""
        system, folder = fs.FileSystem.from_uri(path)

        def close() -> None:
            writer.close()
            done.append((task.partitionId(), len(done), name, writer.docs, writer.tokens, writer.first_key, writer.last_key))

        for piece in pieces(batches, limit=ENCODED_BYTES):
            for doc_id, data in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1).to_pylist())):
                if writer is None:
                    system.create_dir(folder, recursive=True)
                    name = f"part-{task.partitionId():05d}-{len(done):04d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.sst"
                    writer = ShardWriter(system.open_output_stream(f"{folder}/{name}"), encoder.dtype.itemsize, block_bytes)
                writer.add(key_of(doc_id), data)
                if writer.at >= shard_bytes:
                    close()
                    writer = None
        if writer is not None:
            close()
        if done:
            columns = list(zip(*done))
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "seq", "file", "n_docs", "n_tokens", "first_key", "last_key"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("order", F.xxhash64("text"))
    sorted_ = rows.repartitionByRange("doc_id", "order").sortWithinPartitions("doc_id", "order").select("doc_id", "text")
    manifest = materialize(sorted_.mapInArrow(run, MANIFEST), "token-manifest")
    return manifest.withColumn("file", F.concat(F.lit(path + "/"), "file"))


def read_tables(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids before it in all files), n_tokens and ids_crc32 (over u32 ids) of every document, read back from the files.

    The manifest has one row for each file; the files' offsets are added up on the driver.
    """
    spark = manifest.sparkSession
    files, start = [], 0
    for r in manifest.select("file", "n_tokens").orderBy("part", "seq").toLocalIterator():
        files.append((r["file"], start))
        start += r["n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, at in zip(*(c.to_pylist() for c in batch.columns)):
                reader = ShardReader(file)
                for i in range(len(reader.index)):
                    ids, starts, sizes, sums = [], [], [], []
                    for key, data in reader.block(i):
                        own = np.frombuffer(data, dtype=f"<u{reader.width}")
                        ids.append(id_of(key))
                        starts.append(at)
                        sizes.append(len(own))
                        sums.append(zlib.crc32(own.astype("<u4").tobytes()))
                        at += len(own)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, sizes, sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = spark.createDataFrame(files, "file string, start long").repartition(max(1, min(len(files), 4096)))
    return tasks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _holders(files: list[tuple[bytes, bytes, str]], lasts: list[bytes], key: bytes) -> Iterator[int]:
    n = bisect.bisect_left(lasts, key)
    while n < len(files) and files[n][0] <= key:
        yield n
        n += 1


def lookup(spark: SparkSession, manifest: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, ids): the documents with the asked doc_ids, by Bloom filter, sparse index and one block each."""
    files = [(bytes(r["first_key"]), bytes(r["last_key"]), r["file"]) for r in manifest.orderBy("part", "seq").toLocalIterator()]
    lasts = [x[1] for x in files]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, n) for i in batch.column(0).to_pylist() for n in _holders(files, lasts, key_of(i))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32())], names=["doc_id", "n"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader = None, None
        for batch in batches:
            keys, found = [], []
            for doc_id, n in zip(*(c.to_pylist() for c in batch.columns)):
                if n != now:
                    now, reader = n, ShardReader(files[n][2])
                for own in reader.get(doc_id):
                    keys.append(doc_id)
                    found.append(own.astype(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    asked = ids.select(F.col("doc_id").cast("long")).distinct().mapInArrow(route, "doc_id long, n int")
    return asked.repartition("n").sortWithinPartitions("n").mapInArrow(read, "doc_id long, ids array<long>")


def encode_documents(documents: DataFrame, tokenizer_path: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    return read_tables(write_tables(documents, tokenizer_path, end_id, path))
