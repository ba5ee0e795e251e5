"""Who reaches whom, as tiles of the matrix of edges.

Nodes have dense numbers: labels one after the other, and within a label by the first node that a node points at, so that nodes with common
neighbours stand together. The matrix is cut into tiles of SIDE by SIDE numbers; a tile is one row of a DataFrame (i, j, cells), an empty one is none. What two steps reach
is a product of tiles with a common side, so that neither the walks nor the pairs at their ends pass through a shuffle one by one, but as bits.

cells are bytes: a list of places (few) or planes of bits (many). Each cell has a value of 1 to 3: how many edges (or walks) there are, 3 for more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .settle import stored

SIDE = 1_024
PLANE = SIDE * SIDE // 8
#: Up to so many walks through a product of two tiles are listed; beyond, tiles are multiplied as matrices.
LISTED = 500_000
#: Rows of a batch that leaves a task.
ROWS = 65_536

Found = tuple[np.ndarray, np.ndarray]


def packed(places: np.ndarray, values: np.ndarray) -> bytes:
    """cells of sorted distinct places (row * SIDE + column) with their values."""
    planes = int(values.max(initial=1))
    if 4 * len(places) <= planes * PLANE:
        return b"S" + ((places.astype(np.int32) << 2) | values.astype(np.int32)).tobytes()
    out = b"D"
    for p in range(1, planes + 1):
        on = np.zeros(SIDE * SIDE, bool)
        on[places[values >= p]] = True
        out += np.packbits(on).tobytes()
    return out


def packed_matrix(m: np.ndarray) -> bytes:
    """cells of a matrix with values of 0 to 3."""
    flat = m.reshape(-1)
    places = np.flatnonzero(flat)
    return packed(places, flat[places])


def matrix(cells: bytes) -> np.ndarray:
    """SIDE by SIDE values of 0 to 3, as bytes."""
    out = np.zeros(SIDE * SIDE, np.uint8)
    if cells[:1] == b"S":
        x = np.frombuffer(cells, np.int32, offset=1) if len(cells) > 1 else np.empty(0, np.int32)
        out[x >> 2] = x & 3
    else:
        for k in range(1, len(cells), PLANE):
            out += np.unpackbits(np.frombuffer(cells, np.uint8, PLANE, k))
    return out.reshape(SIDE, SIDE)


def places(cells: bytes) -> Found:
    """Sorted places and their values."""
    if cells[:1] == b"S":
        x = np.frombuffer(cells, np.int32, offset=1) if len(cells) > 1 else np.empty(0, np.int32)
        return x >> 2, (x & 3).astype(np.uint8)
    flat = matrix(cells).reshape(-1)
    at = np.flatnonzero(flat).astype(np.int32)
    return at, flat[at]


def turned(cells: bytes) -> bytes:
    """cells with rows as columns."""
    if cells[:1] == b"D":
        return packed_matrix(np.ascontiguousarray(matrix(cells).T))
    at, values = places(cells)
    to = (at % SIDE) * SIDE + at // SIDE
    order = np.argsort(to)
    return packed(to[order], values[order])


def added(parts: list[bytes], most: bool = False) -> bytes:
    """cells of a sum, 3 for more; or with `most` the largest value of each cell."""
    if len(parts) == 1:
        return parts[0]
    total = np.zeros((SIDE, SIDE), np.uint8)
    for p in parts:
        total = np.maximum(total, matrix(p)) if most else np.minimum(total + matrix(p), 3)
    return packed_matrix(total)


def walks(x: Found, y: Found) -> tuple[np.ndarray, np.ndarray] | None:
    """For each walk over a cell of x and one of y: their positions; None if there are more than LISTED."""
    rows = (y[0] // SIDE).astype(np.int64)
    sizes = np.bincount(rows, minlength=SIDE)
    via = (x[0] % SIDE).astype(np.int64)
    many = sizes[via]
    if (total := int(many.sum())) > LISTED:
        return None
    begin = np.cumsum(sizes) - sizes
    first = np.repeat(np.arange(len(via)), many)
    return first, np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin[via], many)


def times(x: bytes, y: bytes, most: int = 3) -> bytes:
    """cells of a product: how many middle nodes there are between two ends, `most` for more. Values of x and y count as 1."""
    a, b = places(x), places(y)
    found = walks(a, b)
    if found is not None:
        ends = (a[0][found[0]] // SIDE).astype(np.int64) * SIDE + b[0][found[1]] % SIDE
        at, n = np.unique(ends, return_counts=True)
        return packed(at, np.minimum(n, most))
    return packed_matrix(np.minimum(dense_times(matrix(x) > 0, matrix(y) > 0), most))


def dense_times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.minimum(x.astype(np.float32) @ y.astype(np.float32), 3).astype(np.uint8)


def on_cycle(x: bytes, y: bytes, z: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x, y and z (from i to k, k to j, j to i) on a closed walk over one cell of each."""
    first, second, third = places(x), places(y), places(z)
    found = walks(second, third)
    if found is not None:
        b, c, a = second[0][found[0]] // SIDE, second[0][found[0]] % SIDE, third[0][found[1]] % SIDE
        closed = (matrix(x) > 0)[a, b]
        return np.unique(a[closed]), np.unique(b[closed]), np.unique(c[closed])
    x_, y_, z_ = (matrix(m) > 0 for m in (x, y, z))
    ab = x_ & (dense_times(y_, z_) > 0).T
    ca = z_ & (dense_times(x_, y_) > 0).T
    return np.flatnonzero(ab.any(1)), np.flatnonzero(ab.any(0)), np.flatnonzero(ca.any(1))


# Over DataFrames


def parts_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def mapped(df: DataFrame, f: Callable[[dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """f makes batches of each row. Rows hold tiles, so batches that enter are small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from f({name: batch.column(c)[k].as_py() for c, name in enumerate(batch.schema.names)})

    return df.mapInArrow(run, schema)


def grouped(df: DataFrame, keys: list[str], f: Callable[[dict, dict[str, list]], Iterator[dict]], schema: str) -> DataFrame:
    """f makes rows of a group's keys and its other columns; a group is what is known of one tile."""
    arrow = pa.schema([pa.field(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for c in schema.split(", ")])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        group = dict(zip(keys, (k.as_py() for k in key)))
        return pa.Table.from_pylist(list(f(group, {c: table.column(c).to_pylist() for c in table.column_names})), arrow)

    spread = df.repartition(parts_of(df), *keys)  # by its small inputs Spark would put all tiles into a few tasks
    return spread.groupBy(*keys).applyInArrow(run, schema)


def numbered(ids: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(id, label, n) of distinct ids, stored; labels begin at a multiple of SIDE. ids: id, label (no null). edges: a, b.

    Sorted by label, the first node that edges lead to (if there are edges), and id: files are ranges of partitions, and the sizes of labels in them, a small table, give the offsets.
    """
    if edges is None:
        keyed = stored(ids.withColumn("near", F.col("id")))
    else:
        near = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near"))
        keyed = stored(ids.join(near, "id", "left").withColumn("near", F.coalesce("near", "id")))
    order = ["label", "near", "id"]
    placed = stored(keyed.repartitionByRange(parts_of(ids), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).drop("near"))
    placed = placed.withColumn("part", F.shiftright("at", 33))
    sizes = placed.groupBy("label", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    within = Window.partitionBy("label").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("offset", F.coalesce(F.sum("size").over(within), F.lit(0)))
    room = sizes.groupBy("label").agg((F.ceil(F.sum("size") / SIDE) * SIDE).alias("room"))
    room = room.withColumn("base", F.coalesce(F.sum("room").over(Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row for each label
    starts = sizes.join(F.broadcast(room), "label").select("label", "part", (F.col("base") + F.col("offset") - F.col("first")).alias("shift"))
    return placed.join(F.broadcast(starts), ["label", "part"]).select("id", "label", (F.col("at") + F.col("shift")).cast("long").alias("n"))  # as many rows as partitions and labels


def side(n: Column) -> Column:
    return F.floor(n / SIDE).cast("long")


def tile_labels(numbers: DataFrame) -> DataFrame:
    """(tile, label): one for each tile."""
    return numbers.groupBy(side(F.col("n")).alias("tile")).agg(F.min("label").alias("label"))


def with_numbers(edges: DataFrame, numbers: DataFrame) -> DataFrame:
    """(x, y): numbers of both ends. edges: a, b."""
    one = edges.join(numbers.select(F.col("id").alias("a"), F.col("n").alias("x")).hint("shuffle_hash"), "a").select("x", "b")
    return one.join(numbers.select(F.col("id").alias("b"), F.col("n").alias("y")).hint("shuffle_hash"), "b").select("x", "y")


def tiled(cells: DataFrame) -> DataFrame:
    """(i, j, cells), stored; a pair that is given several times has its number as its value. cells: x, y."""
    at = (F.col("x") % SIDE * SIDE + F.col("y") % SIDE).cast("int")
    lists = cells.groupBy(side(F.col("x")).alias("i"), side(F.col("y")).alias("j")).agg(F.collect_list(at).alias("at"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k in range(b.num_rows):
                where, n = np.unique(b.column(2)[k].values.to_numpy(), return_counts=True)
                out.append(packed(where, np.minimum(n, 3)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["i", "j", "cells"])

    return stored(lists.mapInArrow(pack, "i long, j long, cells binary"))


def two_steps(first: DataFrame, second: DataFrame) -> DataFrame:
    """(i, j, cells) of each product of a tile of first and one of second; several for the same i and j. The partitions' number is given, as products are many from few tiles."""
    n = parts_of(first)
    left = first.select("i", F.col("j").alias("k"), F.col("cells").alias("x")).repartition(n, "k")
    both = left.join(second.select(F.col("i").alias("k"), "j", F.col("cells").alias("y")).repartition(n, "k"), "k").select("i", "j", "x", "y")

    def f(r: dict) -> Iterator[pa.RecordBatch]:
        if len(out := times(r["x"], r["y"])) > 1:
            yield pa.RecordBatch.from_arrays([pa.array([r["i"]]), pa.array([r["j"]]), pa.array([out], pa.binary())], ["i", "j", "cells"])

    return mapped(both, f, "i long, j long, cells binary")


def summed(parts: DataFrame) -> DataFrame:
    """One (i, j, cells) for each i and j."""
    return grouped(parts, ["i", "j"], lambda k, c: iter([{**k, "cells": added(c["cells"])}]), "i long, j long, cells binary")


def turned_tiles(tiles: DataFrame) -> DataFrame:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), pa.array([turned(c.as_py()) for c in b.column(2)], pa.binary())], ["i", "j", "cells"])

    return tiles.select("i", "j", "cells").mapInArrow(f, "i long, j long, cells binary")


def on_cycles(tiles: DataFrame) -> DataFrame:
    """(n): numbers of nodes on a closed walk of three steps.

    Three tiles that close are found by their sides first, from the side with the fewest tiles, so a hub's pairs of tiles are not listed.
    """
    sides = tiles.select("i", "j")
    degree = sides.unionByName(sides.select(F.col("j").alias("i"), F.col("i").alias("j"))).groupBy("i").agg(F.struct(F.count(F.lit(1)).alias("d"), F.col("i").alias("t")).alias("rank"))
    ranked = sides.join(degree.withColumnRenamed("rank", "ri"), "i").join(degree.select(F.col("i").alias("j"), F.col("rank").alias("rj")), "j")
    out = ranked.filter("ri <= rj").select("i", F.col("j").alias("k"))
    back = ranked.filter("rj <= ri").select(F.col("j").alias("i"), F.col("i").alias("j"))
    three = out.join(back, "i").join(sides.select(F.col("i").alias("k"), "j"), ["k", "j"])
    n = parts_of(tiles)
    for a, b, name in (("i", "k", "x"), ("k", "j", "y"), ("j", "i", "z")):
        three = three.repartition(n, a, b).join(tiles.select(F.col("i").alias(a), F.col("j").alias(b), F.col("cells").alias(name)).repartition(n, a, b), [a, b])

    def f(r: dict) -> Iterator[pa.RecordBatch]:
        found = on_cycle(r["x"], r["y"], r["z"])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[s] * SIDE + at for s, at in zip("ikj", found)]).astype(np.int64))], ["n"])

    return mapped(three, f, "n long").distinct()


def on_two(tiles: DataFrame) -> DataFrame:
    """(n): numbers of nodes on a closed walk of two steps."""
    both = tiles.join(tiles.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("cells").alias("back")), ["i", "j"])

    def f(r: dict) -> Iterator[pa.RecordBatch]:
        rows = np.unique(np.intersect1d(places(r["cells"])[0], places(turned(r["back"]))[0]) // SIDE)
        yield pa.RecordBatch.from_arrays([pa.array((r["i"] * SIDE + rows).astype(np.int64))], ["n"])

    return mapped(both, f, "n long").distinct()


def repeated(tiles: DataFrame) -> DataFrame:
    """(n): rows with a cell of two or more."""

    def f(r: dict) -> Iterator[pa.RecordBatch]:
        at, values = places(r["cells"])
        yield pa.RecordBatch.from_arrays([pa.array((r["i"] * SIDE + np.unique(at[values > 1] // SIDE)).astype(np.int64))], ["n"])

    return mapped(tiles, f, "n long").distinct()


def reached(tiles: DataFrame, mine: DataFrame, both: bool = False) -> DataFrame:
    """(t, o, up, down), stored: cells of what rows of a tile reach in one or two steps; with `both` also of what reaches them, rows still theirs. mine: (tile) of the rows that are asked for.

    A loop leads nowhere that one step does not, and only a loop can be used twice in two steps, so a product of plain tiles tells which trails there are.
    """
    own = lambda c: mine.select(F.col("tile").alias(c), F.lit(True).alias(f"own_{c}"))
    n = parts_of(tiles)
    flagged = tiles.join(F.broadcast(own("i")), "i", "left").join(F.broadcast(own("j")), "j", "left")  # a row for SIDE nodes
    left = flagged.select("i", F.col("j").alias("k"), F.col("cells").alias("x"), "own_i").repartition(n, "k")
    right = flagged.select(F.col("i").alias("k"), "j", F.col("cells").alias("y"), "own_j").repartition(n, "k")
    two = left.join(right, "k").select("i", "j", "x", "y", "own_i", "own_j")
    one = flagged.select("i", "j", F.col("cells").alias("x"), F.lit(None).cast("binary").alias("y"), "own_i", "own_j")
    asked = F.col("own_i") if not both else F.coalesce(F.col("own_i"), F.col("own_j"))

    def f(r: dict) -> Iterator[pa.RecordBatch]:
        cells = r["x"] if r["y"] is None else times(r["x"], r["y"], 1)
        if len(cells) > 1:
            rows = [(r["i"], r["j"], cells, None)] if r["own_i"] else []
            rows += [(r["j"], r["i"], None, turned(cells))] if both and r["own_j"] else []
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["t", "o", "up", "down"])

    parts = mapped(two.unionByName(one).filter(asked), f, "t long, o long, up binary, down binary")

    def merge(key: dict, c: dict[str, list]) -> Iterator[dict]:
        sides = {s: [x for x in c[s] if x is not None] for s in ("up", "down")}
        yield {**key, **{s: added(x, most=True) if x else None for s, x in sides.items()}}

    return stored(grouped(parts, ["t", "o"], merge, "t long, o long, up binary, down binary"))


def row_counts(found: DataFrame) -> DataFrame:
    """(n, o, up, down, total): for each row and tile how many cells each side has, and how many either has. found: as reached() gives it."""

    def f(r: dict) -> Iterator[pa.RecordBatch]:
        up, down = (matrix(r[s]) > 0 if r[s] is not None else np.zeros((SIDE, SIDE), bool) for s in ("up", "down"))
        counts = [up.sum(1), down.sum(1), (up | down).sum(1)]
        at = np.flatnonzero(counts[2])
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (r["t"] * SIDE + at, np.full(len(at), r["o"]), *(c[at] for c in counts))], ["n", "o", "up", "down", "total"])

    return mapped(found, f, "n long, o long, up long, down long, total long")


def named(numbers: DataFrame) -> DataFrame:
    """(tile, ids): the ids of a tile in order; places without one are null."""
    held = numbers.groupBy(side(F.col("n")).alias("tile")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("n") % SIDE).cast("int"), "id"))).alias("of"))
    return held.select("tile", F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda k: F.try_element_at("of", k)).alias("ids"))


def listed(found: DataFrame, cells: str, rows: tuple[str, DataFrame], columns: tuple[str, DataFrame], names: tuple[str, str]) -> DataFrame:
    """A row for each cell, with both names. rows and columns: the tile's column, and named() of its numbers."""
    both = found.filter(F.col(cells).isNotNull()).select(F.col(cells).alias("cells"), F.col(rows[0]).alias("r"), F.col(columns[0]).alias("c"))
    both = both.join(rows[1].select(F.col("tile").alias("r"), F.col("ids").alias("row_ids")), "r").join(columns[1].select(F.col("tile").alias("c"), F.col("ids").alias("column_ids")), "c")

    def f(r: dict) -> Iterator[pa.RecordBatch]:
        at, a, b = places(r["cells"])[0], pa.array(r["row_ids"], pa.string()), pa.array(r["column_ids"], pa.string())
        for k in range(0, len(at), ROWS):
            part = at[k : k + ROWS]
            yield pa.RecordBatch.from_arrays([a.take(pa.array(part // SIDE)), b.take(pa.array(part % SIDE))], list(names))

    return mapped(both.select("cells", "row_ids", "column_ids").repartition(parts_of(found)), f, f"{names[0]} string, {names[1]} string")


def valued(numbers: DataFrame, values: DataFrame) -> DataFrame:
    """(tile, q): for the nodes of a tile in order the number of their value, -1 where there is none. values: (id, q)."""
    held = numbers.join(values, "id").groupBy(side(F.col("n")).alias("tile")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("n") % SIDE).cast("int"), "q"))).alias("of"))
    return held.select("tile", F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda k: F.coalesce(F.try_element_at("of", k), F.lit(-1).cast("long"))).alias("q"))


def by_value(found: DataFrame, columns: DataFrame, sides: dict[str, int]) -> DataFrame:
    """(t, v, part, cells): columns are values instead of nodes, each once for a row. found: t, o and columns of cells; columns: valued(); sides: the part that each column of cells becomes."""
    joined = found.join(columns.select(F.col("tile").alias("o"), "q"), "o").select("t", "q", *sides)

    def f(r: dict) -> Iterator[pa.RecordBatch]:
        q = np.array(r["q"], np.int64)
        for s, part in sides.items():
            if r[s] is None:
                continue
            at = places(r[s])[0].astype(np.int64)
            to = q[at % SIDE]
            row, to = (at // SIDE)[to >= 0], to[to >= 0]
            for v in np.unique(to // SIDE):
                own = to // SIDE == v
                there = np.unique(row[own] * SIDE + to[own] % SIDE)
                yield pa.RecordBatch.from_arrays([pa.array([r["t"]]), pa.array([int(v)]), pa.array([part], pa.int32()), pa.array([packed(there, np.ones(len(there), np.uint8))], pa.binary())], ["t", "v", "part", "cells"])

    return mapped(joined.repartition(parts_of(found)), f, "t long, v long, part int, cells binary")


def merged(parts: DataFrame) -> DataFrame:
    """One (t, v, part, cells) of those that by_value() gives."""
    return grouped(parts, ["t", "v", "part"], lambda k, c: iter([{**k, "cells": added(c["cells"], most=True)}]), "t long, v long, part int, cells binary")


def part_counts(found: DataFrame, sets: dict[str, tuple[int, ...]]) -> DataFrame:
    """(n, v, and a column for each of sets): for each row and tile how many different values its parts have together. found: as by_value() gives it."""
    schema = "n long, v long, " + ", ".join(f"{s} long" for s in sets)

    def count(key: dict, c: dict[str, list]) -> Iterator[dict]:
        held = {p: matrix(added([x for x, y in zip(c["cells"], c["part"]) if y == p], most=True)) > 0 for p in set(c["part"])}
        sums = {}
        for s, parts in sets.items():
            there = [held[p] for p in parts if p in held]
            sums[s] = np.logical_or.reduce(there).sum(1) if there else np.zeros(SIDE, np.int64)
        for r in np.flatnonzero(sum(sums.values())):
            yield {"n": int(key["t"] * SIDE + r), "v": key["v"], **{s: int(x[r]) for s, x in sums.items()}}

    return grouped(found, ["t", "v"], count, schema)


def firsts(found: DataFrame, names: DataFrame, keep: int) -> DataFrame:
    """(n, part, value): the first `keep` values of each row in each tile. found: merged(); names: named() of the values."""
    joined = found.join(names.select(F.col("tile").alias("v"), "ids"), "v").select("t", "part", "cells", "ids")

    def f(r: dict) -> Iterator[pa.RecordBatch]:
        at = places(r["cells"])[0]
        row = at // SIDE
        at = at[np.arange(len(at)) - np.searchsorted(row, row) < keep]
        yield pa.RecordBatch.from_arrays([pa.array((r["t"] * SIDE + at // SIDE).astype(np.int64)), pa.array(np.full(len(at), r["part"], np.int32)), pa.array(r["ids"], pa.string()).take(pa.array(at % SIDE))], ["n", "part", "value"])

    return mapped(joined, f, "n long, part int, value string")


def texts(found: DataFrame, names: DataFrame, separator: str) -> DataFrame:
    """(n, part, v, text): the values of each row in each tile, joined in their order. found: merged(); names: named() of the values."""
    joined = found.join(names.select(F.col("tile").alias("v"), "ids"), "v").select("t", "part", "v", "cells", "ids")

    def f(r: dict) -> Iterator[pa.RecordBatch]:
        at, ids = places(r["cells"])[0], np.array(r["ids"], object)
        rows, begin = np.unique(at // SIDE, return_index=True)
        ends = [*begin[1:], len(at)]
        for k in range(0, len(rows), 64):
            out = [separator.join(ids[at[a:b] % SIDE]) for a, b in zip(begin[k : k + 64], ends[k : k + 64])]
            n = len(out)
            yield pa.RecordBatch.from_arrays([pa.array((r["t"] * SIDE + rows[k : k + 64]).astype(np.int64)), pa.array([r["part"]] * n, pa.int32()), pa.array([r["v"]] * n, pa.int64()), pa.array(out, pa.string())], ["n", "part", "v", "text"])

    return mapped(joined.repartition(parts_of(found)), f, "n long, part int, v long, text string")


def far(tiles: DataFrame, loops: DataFrame) -> DataFrame:
    """(t, o, cells), stored: ends of undirected trails of two or three steps. tiles: both directions, without loops, values count parallel edges; loops: (n) of nodes that have one.

    Two steps s-x-t are a trail, but for s = t, which needs a second edge from s to x. Of three steps s-x-y-t only those with x = t or y = s can use an edge twice. So if s and t
    have no edge, any walk is a trail. If they have one, a walk is needed with y other than s and two ways from s to y (one is by t); or a second edge
    from s to any x but t, or from t to any y but s, before or after which the edge s-t is taken; or three edges s-t.
    A loop adds the neighbours of its node, and its node to them.
    """
    two = stored(summed(two_steps(tiles, tiles)))
    n = parts_of(tiles)

    def marked(r: dict) -> Iterator[pa.RecordBatch]:
        m = matrix(r["cells"])
        at = np.flatnonzero((m > 1).any(1))
        yield pa.RecordBatch.from_arrays([pa.array((r["i"] * SIDE + at).astype(np.int64)), pa.array((m[at] > 1).sum(1).astype(np.int64))], ["n", "double"])

    flags = mapped(tiles, marked, "n long, double long").groupBy("n").agg(F.sum("double").alias("double")).join(loops.withColumn("loop", F.lit(True)), "n", "full")
    of = flags.groupBy(side(F.col("n")).alias("tile")).agg(F.collect_list(F.struct((F.col("n") % SIDE).alias("at"), F.coalesce("double", F.lit(0)).alias("double"), F.coalesce("loop", F.lit(False)).alias("loop"))).alias("flags"))
    edges = tiles.join(of.select(F.col("tile").alias("i"), F.col("flags").alias("fi")), "i", "left").join(of.select(F.col("tile").alias("j"), F.col("flags").alias("fj")), "j", "left")
    arrow = ["i", "j", "part", "cells"]
    row = lambda i, j, part, cells: pa.RecordBatch.from_arrays([pa.array([i]), pa.array([j]), pa.array([part], pa.int32()), pa.array([cells], pa.binary())], arrow)

    def spread(flags: list | None) -> tuple[np.ndarray, np.ndarray]:
        double, loop = np.zeros(SIDE, np.int64), np.zeros(SIDE, bool)
        for x in flags or ():
            double[x["at"]], loop[x["at"]] = x["double"], x["loop"]
        return double, loop

    def beside(r: dict) -> Iterator[pa.RecordBatch]:
        """Ends with an edge between them that is on a trail by a second edge or a loop."""
        m = matrix(r["cells"])
        (di, li), (dj, lj) = spread(r["fi"]), spread(r["fj"])
        twice = (m > 1).astype(np.int64)
        on = (m > 0) & ((di[:, None] > twice) | (dj[None, :] > twice) | (m > 2) | li[:, None] | lj[None, :])
        yield row(r["i"], r["j"], SURE, packed_matrix(on.astype(np.uint8)))

    def back(r: dict) -> Iterator[pa.RecordBatch]:
        """Nodes that a second edge leads back to."""
        yield row(r["tile"], r["tile"], SURE, packed_matrix(np.diag(spread(r["flags"])[0] > 0).astype(np.uint8)))

    def third(r: dict) -> Iterator[pa.RecordBatch]:
        """1 where a walk of two steps is led on, 2 where one with two ways and another middle than its start is."""
        w, out = matrix(r["x"]), matrix(times(r["x"], r["y"], 1))
        ways = w > 1
        if r["i"] == r["k"]:
            np.fill_diagonal(ways, False)
        if ways.any():
            out += matrix(times(packed_matrix(ways.astype(np.uint8)), r["y"], 1))
        if out.any():
            yield row(r["i"], r["j"], THIRD, packed_matrix(out))

    on = two.select("i", F.col("j").alias("k"), F.col("cells").alias("x")).repartition(n, "k").join(tiles.select(F.col("i").alias("k"), "j", F.col("cells").alias("y")).repartition(n, "k"), "k").select("i", "k", "j", "x", "y")
    schema = "i long, j long, part int, cells binary"
    parts = mapped(on, third, schema).unionByName(mapped(edges.select("i", "j", "cells", "fi", "fj").repartition(n), beside, schema)).unionByName(mapped(of.filter(F.exists("flags", lambda x: x["double"] > 0)), back, schema))
    parts = parts.unionByName(tiles.select("i", "j", F.lit(EDGE).alias("part"), "cells")).unionByName(two.select("i", "j", F.lit(TWO).alias("part"), "cells"))

    def ends(key: dict, c: dict[str, list]) -> Iterator[dict]:
        of_part = lambda p: [x for x, y in zip(c["cells"], c["part"]) if y == p]
        one = lambda p: matrix(added(x, most=True)) if (x := of_part(p)) else np.zeros((SIDE, SIDE), np.uint8)
        second, edge, on = one(TWO) > 0, one(EDGE) > 0, one(THIRD)
        if key["i"] == key["j"]:
            np.fill_diagonal(second, False)
        out = second | (one(SURE) > 0) | ((on > 0) & ~edge) | (on > 1)
        if out.any():
            yield {"t": key["i"], "o": key["j"], "cells": packed_matrix(out.astype(np.uint8))}

    return stored(grouped(parts, ["i", "j"], ends, "t long, o long, cells binary"))


SURE, THIRD, EDGE, TWO = range(4)
