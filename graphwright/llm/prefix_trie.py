"""The trie of conversations by their turns: who shares which beginning, and what sharing it saves.

A turn is known by a fixed-width id of 16 bytes (SHA-256 of role and text, cut; equal turns have equal ids), so a conversation is a key of
whole ids. Keys are range-sorted with their conv_id, so each task gets a stretch of the sorted keys, however many conversations
share a turn, a beginning or all of their turns. A task builds adaptive radix trees over runs of its keys (`radix`; compressed paths, layouts that
grow) and reads the trie's nodes from them: the prefixes that end at whole turns.

A node whose members all lie within a run is finished there. Prefixes of a run's first or last key can go on in its neighbours and
stay open: at most two paths for each run. Open paths are merged, first within the task, then over FAN neighbouring stretches at a time, until
one is left; a merge finishes what does not touch its own two ends. So no step holds more than FAN pairs of paths. Parents that were
open when a child was finished are joined to it at last. The ids of conversations that end at a stretch's first or last key are written in
chunks, whose hash one task takes in a stream.

Cases: null role or text is empty; turns are ordered by turn (null first), then role, then id, repeated rows being repeated turns; rows without
conv_id are left out; a conversation without turns belongs to the root alone; an empty table gives an empty result, without a root; other
columns are ignored. A conversation is one key of 16 bytes and one number for each turn, and has to fit into a task.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .radix import Tree
from .storage import materialize

WIDTH = 16
RUN_KEYS, RUN_BYTES = 20_000, 16 << 20
CHUNK_BYTES = 1 << 20
FAN = 64
BROADCAST_ROWS = 100_000
ROWS_OUT = 20_000
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
PARTS = f"kind int, part long, {NODE}, node binary, parent binary, n_text long, chunked boolean, first boolean, last boolean, chunk int, ids binary"
CLOSED, OPEN, ENDS = 0, 1, 2
KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
FIELDS = [tuple(f.split()) for f in PARTS.split(", ")]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, century, ids, sizes): the turns of each conversation in order, as hexadecimal ids and numbers of code points.

    century is conv_id without its last two digits; conversations of one lie in one partition.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    own = F.col("conv_id").cast("long")
    rows = conversations.select(own.alias("conv_id"), (own - own % 100).alias("century"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
                                F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH).alias("id"), F.length(text).alias("size"))
    turn = F.struct(F.col("turn").isNotNull().alias("given"), "turn", "role", "id", "size")
    lists = rows.filter("conv_id is not null").repartition("century").groupBy("century", "conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return lists.select("conv_id", "century", F.col("turns.id").alias("ids"), F.col("turns.size").alias("sizes"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Each conversation with its first h turns replaced by those of its century's first, h being crc32 of conv_id modulo 6."""
    h = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    first = lambda c: F.first(F.when(F.col("conv_id") == F.col("century"), F.slice(c, 1, 5)), True).over(Window.partitionBy("century"))
    swap = lambda c: F.concat(F.slice(F.coalesce(F.col(f"first_{c}"), F.slice(c, 1, 0)), 1, h), F.slice(c, h + 1, F.greatest(F.size(c) - h, F.lit(0)))).alias(c)
    # The window is over the partitions that ordered_turns() made, at most 199 conversations each.
    return turns.withColumns({f"first_{c}": first(c) for c in ("ids", "sizes")}).select("conv_id", swap("ids"), swap("sizes"))


@dataclass
class Path:
    """An open node: what is known of it so far, from finished children and from members."""

    node: bytes
    parent: bytes
    depth: int
    n_text: int
    conv_id: int
    n_convs: int
    n_children: int
    n_leaves: int
    saved: int
    ends: str | None
    chunked: bool
    first: bool
    last: bool


def _down(above: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(above + turn, digest_size=WIDTH).digest()


def _names(key: bytes) -> list[bytes]:
    """Names of the prefixes of key, the empty one first."""
    out = [bytes(WIDTH)]
    for at in range(0, len(key), WIDTH):
        out.append(_down(out[-1], key[at : at + WIDTH]))
    return out


class Rows:
    """Rows of PARTS, given out in batches."""

    def __init__(self, part: int):
        self.part, self.rows = part, []

    def add(self, kind: int, **values) -> None:
        self.rows.append({"kind": kind, "part": self.part} | values)

    def take(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in self.rows], KINDS[k]) for n, k in FIELDS], names=[n for n, _ in FIELDS])
            self.rows = []

    def closed(self, p: Path) -> None:
        self.add(CLOSED, conv_id=p.conv_id, depth=p.depth, n_convs=p.n_convs, n_children=p.n_children, n_leaves=p.n_leaves or 1, saved_tokens=p.saved + (p.n_convs - 1) * p.n_text,
                 ends_sha256=None if p.chunked else p.ends or NOTHING, node=p.node, parent=p.parent if p.depth else None, chunked=p.chunked)

    def open(self, p: Path) -> None:
        self.add(OPEN, conv_id=p.conv_id, depth=p.depth, n_convs=p.n_convs, n_children=p.n_children, n_leaves=p.n_leaves, saved_tokens=p.saved, ends_sha256=p.ends, node=p.node, parent=p.parent,
                 n_text=p.n_text, chunked=p.chunked, first=p.first, last=p.last)


def merge(shards: list[list[Path]], out: Rows, final: bool = False) -> list[Path]:
    """Open paths of neighbouring stretches as those of one; what neither end touches is finished, or all of it if they are the whole."""
    held: dict[bytes, Path] = {}
    for i, shard in enumerate(shards):
        for p in shard:
            first, last = p.first and i == 0 and not final, p.last and i == len(shards) - 1 and not final
            if (q := held.get(p.node)) is None:
                held[p.node] = Path(p.node, p.parent, p.depth, p.n_text, p.conv_id, p.n_convs, p.n_children, p.n_leaves, p.saved, p.ends, p.chunked, first, last)
                continue
            q.conv_id, q.n_convs, q.n_children, q.n_leaves, q.saved = min(q.conv_id, p.conv_id), q.n_convs + p.n_convs, q.n_children + p.n_children, q.n_leaves + p.n_leaves, q.saved + p.saved
            q.ends, q.chunked, q.first, q.last = q.ends or p.ends, q.chunked or p.chunked, q.first or first, q.last or last
    left = []
    for p in sorted(held.values(), key=lambda p: -p.depth):
        if p.first or p.last:
            left.append(p)
            continue
        out.closed(p)
        if p.depth:
            above = held[p.parent]
            above.n_children, above.n_leaves, above.saved = above.n_children + 1, above.n_leaves + (p.n_leaves or 1), above.saved + p.saved + (p.n_convs - 1) * p.n_text
    return left


@dataclass
class Ended:
    """The conversations that have one key."""

    key: bytes
    sizes: np.ndarray
    conv_id: int
    n: int
    ends: str | None
    chunked: bool


def _run(keys: list[Ended], out: Rows) -> list[Path]:
    """The trie's nodes over a run of different keys, by a radix tree: finished ones go out, open ones come back."""
    tree = Tree()
    for k in keys:
        tree.insert(k.key, k)
    depth, parent, n_convs, least, ends, size = [], [], [], [], [], []
    for d, above, value in tree.walk(WIDTH):
        me = len(depth)
        depth.append(d)
        parent.append(above)
        size.append(-1)
        n_convs.append(value.n if value else 0)
        least.append(value.conv_id if value else None)
        ends.append(value)
        if value is not None:
            while me >= 0 and size[me] < 0:  # prefixes between this key and the one before
                size[me] = int(value.sizes[depth[me] - 1]) if depth[me] else 0
                me = parent[me]
    n = len(depth)
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    names: dict[int, tuple[bytes, bool, bool]] = {}
    for i, name in enumerate(_names(keys[0].key)):  # the first key's prefixes come first
        names[i] = (name, True, False)
    at, last = parent_of_last(ends, parent), _names(keys[-1].key)
    for i in at:
        names[i] = (last[depth[i]], i in names, True)
    for i in range(n - 1, -1, -1):
        if (above := parent[i]) >= 0:
            n_convs[above] += n_convs[i]
            least[above] = least[i] if least[above] is None else min(least[above], least[i])
        if i in names:
            continue  # what an open node passes on is known when it is finished
        leaves[i] = leaves[i] or 1
        saved[i] += (n_convs[i] - 1) * size[i]
        children[above] += 1
        leaves[above] += leaves[i]
        saved[above] += saved[i]
    left = []
    for i in range(n):
        value, above = ends[i], parent[i]
        if i in names:
            name, first, final = names[i]
            left.append(Path(name, names[above][0] if above >= 0 else b"", depth[i], size[i], least[i], n_convs[i], children[i], leaves[i], saved[i], value and value.ends, bool(value and value.chunked), first, final))
        else:
            known = above not in names
            out.add(CLOSED, conv_id=least[i], depth=depth[i], parent_conv_id=least[above] if known else None, n_convs=n_convs[i], n_children=children[i], n_leaves=leaves[i], saved_tokens=saved[i],
                    ends_sha256=value.ends if value else NOTHING, parent=None if known else names[above][0], chunked=False)
    return left


def parent_of_last(ends: list[Ended | None], parent: list[int]) -> list[int]:
    """Numbers of the last key's prefixes: the last node is its end, as keys go up."""
    at, out = len(ends) - 1, []
    while at >= 0:
        out.append(at)
        at = parent[at]
    return out


def _stretch(batches: Iterator[pa.RecordBatch], run_keys: int, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, key, sizes) of a task as rows of PARTS."""
    part = TaskContext.get().partitionId()
    out, carried, run, held = Rows(part), None, [], 0
    now: Ended | None = None
    digest, text, begun, chunks, at_start = hashlib.sha256(), bytearray(), False, 0, True

    def flush() -> None:
        nonlocal chunks, text
        out.add(ENDS, node=_names(now.key)[-1], chunk=chunks, ids=bytes(text))
        chunks, text = chunks + 1, bytearray()

    def finish(end: bool) -> None:
        """The key now is complete, unless it is the stretch's first or last one."""
        if at_start or end:
            now.chunked = True
            flush()
        else:
            now.ends = digest.hexdigest()

    for batch in batches:
        ids, keys, sizes = batch.column(0).to_numpy(zero_copy_only=False).tolist(), batch.column(1), batch.column(2)
        for i, conv_id in enumerate(ids):
            key = keys[i].as_py()
            if now is None or key != now.key:
                if now is not None:
                    finish(False)
                    at_start = False
                    run.append(now)
                    held += len(now.key)
                    if len(run) >= run_keys or held >= RUN_BYTES:
                        paths = _run(run, out)
                        carried, run, held = paths if carried is None else merge([carried, paths], out), [], 0
                        yield from out.take(ROWS_OUT)
                now = Ended(key, sizes[i].values.to_numpy(zero_copy_only=False), conv_id, 0, None, False)
                digest, text, begun, chunks = hashlib.sha256(), bytearray(), False, 0
            data = b"%s%d" % (b"," if begun else b"", conv_id)
            begun = True
            digest.update(data)
            text += data
            now.n, now.conv_id = now.n + 1, min(now.conv_id, conv_id)
            if len(text) >= chunk_bytes:
                flush()
                yield from out.take(ROWS_OUT)
    if now is not None:
        finish(True)
        run.append(now)
        paths = _run(run, out)
        for p in paths if carried is None else merge([carried, paths], out):
            out.open(p)
    yield from out.take()


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends) from chunks sorted by node, stretch and chunk."""
    now, digest, again, done = None, None, -1, []
    for batch in batches:
        for node, part, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if node != now:
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest, again = node, hashlib.sha256(), part
            if part != again:  # chunks of a stretch begin without a comma
                digest.update(b",")
                again = part
            digest.update(ids)
    if now is not None:
        done.append((now, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], names=["own", "ends"])


def _merged(final: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out, shards = Rows(int(key[0])), []
        for _, own in rows.groupby("part", sort=True):
            shards.append([Path(r.node, r.parent, r.depth, r.n_text, r.conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256, r.chunked, r.first, r.last) for r in own.itertuples()])
        for p in merge(shards, out, final):
            out.open(p)
        return next(out.take()).to_pandas(integer_object_nulls=True)

    return run


def build_trie(turns: DataFrame, run_keys: int = RUN_KEYS, chunk_bytes: int = CHUNK_BYTES, fan: int = FAN) -> DataFrame:
    """One row for each distinct beginning of whole turns. turns: conv_id (not null, unique), ids (hexadecimal, 2 * WIDTH digits each) and sizes.

    conv_id: the smallest member; depth; parent_conv_id; n_convs: members; n_children; n_leaves: nodes below or here without children; saved_tokens: over
    the nodes below and here, (n_convs - 1) times the last turn's size; ends_sha256: of the members that end here, ascending, comma-joined.
    """
    keys = materialize(turns.select("conv_id", F.unhex(F.array_join("ids", "")).alias("key"), F.col("sizes").cast("array<int>").alias("sizes")), "trie-keys")
    stretch = functools.partial(_stretch, run_keys=run_keys, chunk_bytes=chunk_bytes)
    parts = materialize(keys.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(stretch, PARTS), "trie-stretches")
    closed, open_ = [parts.filter(f"kind = {CLOSED}")], parts.filter(f"kind = {OPEN}")
    most = parts.agg(F.max("part").alias("most")).head()["most"] or 0
    while True:
        most //= fan
        group = F.expr(f"part div {fan}").alias("stretch")
        made = materialize(open_.groupBy(group).applyInPandas(_merged(most == 0), PARTS), "trie-merged")
        closed, open_ = [*closed, made.filter(f"kind = {CLOSED}")], made.filter(f"kind = {OPEN}")
        if most == 0:
            break
    rows = closed[0]
    for x in closed[1:]:
        rows = rows.unionByName(x)
    columns = [f.split()[0] for f in NODE.split(", ")]
    once_open = materialize(rows.filter("node is not null"), "trie-once-open")
    few = once_open.count() <= BROADCAST_ROWS
    ends = parts.filter(f"kind = {ENDS}").select("node", "part", "chunk", "ids").repartition("node").sortWithinPartitions("node", "part", "chunk").select("node", "part", "ids").mapInArrow(_hash_ends, "own binary, ends string")
    known = once_open.filter("not chunked").select("parent", *columns)
    hashed = once_open.filter("chunked").join(ends, F.col("node") == F.col("own")).withColumn("ends_sha256", F.col("ends")).select("parent", *columns)
    rows = rows.filter("node is null").select("parent", *columns).unionByName(known).unionByName(hashed)
    above = once_open.select(F.col("node").alias("above"), F.col("conv_id").alias("above_id"))
    waiting = rows.filter("parent is not null").join(F.broadcast(above) if few else above, F.col("parent") == F.col("above")).withColumn("parent_conv_id", F.col("above_id"))
    return rows.filter("parent is null").select(columns).unionByName(waiting.select(columns))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations, each with its century's beginning."""
    return build_trie(rebuilt(ordered_turns(conversations)))
