"""Word positions and hashes for Arrow batches of text, computed on the UTF-8 bytes with numpy.

A word is a maximal run of characters outside U+0020 and U+0009..U+000D. All
of these separators are single bytes in UTF-8, so bytes suffice. Null texts
count as empty. Batches are cut into pieces of a few MB, so memory does not
depend on the batch size; a longer document is a piece of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash

PIECE_BYTES = 1 << 20
#: Words or hashes of a long text that are unpacked at a time.
BLOCK = 1 << 16
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_LONG = 256
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse. Only tables for a usual piece are kept."""
    if n <= len(_POWERS.get("up", ())):
        return _POWERS["up"][:n], _POWERS["down"][:n]
    size, made = max(n, PIECE_BYTES // 2), {}
    for name, base in (("up", _ODD), ("down", _INVERSE)):
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        made[name] = np.cumprod(steps, dtype=np.uint64)
    if size <= PIECE_BYTES // 2:
        _POWERS.update(made)
    return made["up"][:n], made["down"][:n]


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[s:e] for every pair, by prefix sums of a polynomial modulo 2**64.

    For short ranges of values that are hashes themselves (windows of words). Long ranges with few different values can
    meet by construction (Thue-Morse sequences), so whole texts and words are hashed otherwise.
    """
    up, down = _powers(len(values) + 1)
    total = np.empty(len(values) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def blocks(n: int, starts: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Cuts n values, in runs that begin at starts (the first at 0, none empty), into blocks: the block, its runs, and where these begin in it."""
    for at in range(0, n, BLOCK):
        end = min(at + BLOCK, n)
        runs = slice(int(np.searchsorted(starts, at, side="right")) - 1, int(np.searchsorted(starts, end)))
        yield slice(at, end), runs, np.maximum(starts[runs] - at, 0)


def majority_bits(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of hashes the bits that over half of them have set."""
    ones = np.zeros((len(starts), 64), dtype=np.int64)
    for block, runs, edges in blocks(len(hashes), starts):
        bits = np.unpackbits(hashes[block].astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones[runs] += np.add.reduceat(bits, edges, axis=0, dtype=np.int32)
    counts = np.diff(np.append(starts, len(hashes)))
    return np.packbits(2 * ones > counts[:, None], axis=1).view(">u8")[:, 0].astype(np.uint64)


def byte_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes data[s:e] for every pair: eight bytes at a time into a mixed state; XXH3 for long ranges."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    left = ends - starts
    state = mix(left.astype(np.uint64) + np.uint64(_ODD))
    long_ = np.flatnonzero(left > _LONG)
    for i in long_.tolist():
        state[i] = xxhash.xxh3_64_intdigest(padded[starts[i] : ends[i]])
    at = np.flatnonzero((left > 0) & (left <= _LONG))
    begin, left = starts[at], left[at]
    while len(at):
        held = eights[begin]
        short = left < 8
        held[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
        state[at] = mix(state[at] ^ held)
        more = left > 8
        at, begin, left = at[more], begin[more] + 8, left[more] - 8
    return state


class Words:
    """Words of a list of texts, with A-Z lower-cased if asked; docs[i]:docs[i + 1] are the words of text i."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = column.cast(pa.large_string()).fill_null("")
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        self.bytes = data[offsets[0] : offsets[-1]]
        if lower:
            self.bytes = _LOWER[self.bytes]
        self.offsets = offsets - offsets[0]
        inside = ~_SPACE[self.bytes]
        size = len(self.bytes)
        before, after = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cut = self.offsets[1:-1]
        before[cut[cut < size]] = False
        after[cut[cut > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.docs = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.docs)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word."""
        return byte_hash(self.bytes, self.starts, self.ends)

    def digests(self) -> list[bytes]:
        """128-bit digest of the word sequence of every text."""
        out = []
        for begin, end in zip(self.docs.tolist(), self.docs[1:].tolist()):
            state = xxhash.xxh3_128()
            for at in range(begin, end, BLOCK):
                state.update(b" " if at > begin else b"")
                state.update(self.joined(at, min(at + BLOCK, end)))
            out.append(state.digest())
        return out

    def joined(self, first: int, end: int) -> bytes:
        """Words first to end - 1, of one text, with a space between them."""
        return b" ".join(self.bytes[self.starts[first] : self.ends[end - 1]].tobytes().split())

    def owners(self) -> np.ndarray:
        """For every word the index of its text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, k: int) -> np.ndarray:
        """Index of the first word of every window of k words that stays within one text."""
        first = np.arange(len(self) - k + 1) if len(self) >= k else np.zeros(0, dtype=np.int64)
        owner = self.owners()
        return first[owner[first] == owner[first + k - 1]] if len(first) else first


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, and others need it meanwhile."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES, clean: bool = True) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a piece hold about limit bytes (one longer text: alone)."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(column))
        lengths = pa.compute.binary_length(sizes).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        begin, held = 0, 0
        for i, length in enumerate(lengths.tolist()):
            if i > begin and held + length > limit:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += length
        if begin < batch.num_rows:
            yield batch.slice(begin)
    if clean:
        give_back()
