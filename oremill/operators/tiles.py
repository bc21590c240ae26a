"""Pairs of members, tile by tile: members are numbered in their order and cut into blocks, and a task holds two blocks and finds all of their pairs.
Only members are shuffled, each to the tiles of its block; a pair comes out of one tile, once and finished."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oremill.functions.shared import written

#: Most members of a block, and of one whose tiles hold no array of their cells; fewer members are cut into up to FEW blocks of at least LEAST, so that there are tiles for all cores.
BLOCK, WIDE, FEW, LEAST = 32_768, 131_072, 8, 256
#: Most partitions of tiles.
PARTITIONS = 10_000
#: Cells of a tile that are marked at once, and meetings that are expanded at once.
CELLS, MOST = 1 << 22, 1 << 20


def dense_index(keys: DataFrame, key: str, index: str) -> DataFrame:
    """Distinct non-null keys numbered 0, 1, .. in their order. Partitions are sorted ranges; only their counts meet on the driver."""
    ordered = keys.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).withColumn("_n", F.monotonically_increasing_id())
    ordered = written(ordered, "index")
    part, place = F.shiftright("_n", 33), F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r[0], r[1]) for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, before = [], 0
    for p, n in counts:
        offsets.append((p, before))
        before += n
    table = F.broadcast(ordered.sparkSession.createDataFrame(offsets, "p bigint, o bigint"))
    return ordered.withColumn("p", part.cast("bigint")).join(table, "p").select(key, (place + F.col("o")).alias(index))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A table for each value of the first column, by which the batches are sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tile = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1), len(tile)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[-1].column(0)[0] != batch.column(0)[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def tiled(members: DataFrame, member: str, block: int | None, work: Callable[[pa.Table, pa.Table, bool], Iterator[pa.RecordBatch]], schema: T.StructType, most: int = BLOCK) -> DataFrame:
    """What work(left, right, own) yields on every tile. members has each member once, without nulls. left and right are tables of it in the order of the members; those of
    the left come before those of the right, or else, with `own`, left and right are the same ones."""
    members = written(members, "members")
    numbers = dense_index(members, member, "_number")
    count = numbers.count()
    width = block or min(most, max(LEAST, -(-count // FEW)))
    blocks = max(1, -(-count // width))
    tiles = blocks * (blocks + 1) // 2
    parts = min(tiles, PARTITIONS)
    names = members.columns
    own = F.floor(F.col("_number") / width).cast("bigint")
    placed = members.join(numbers, member).select("_number", *names, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("_other"))
    low, high = F.least(own, "_other"), F.greatest(own, "_other")
    placed = placed.select((F.shiftright(high * (high + 1), 1) + low).alias("_tile"), "_number", *names)
    placed = placed.repartitionById(parts, F.pmod("_tile", F.lit(parts)).cast("int")).sortWithinPartitions("_tile", "_number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            number = table.column(1).to_numpy()
            table = table.drop_columns(["_tile", "_number"]).combine_chunks()
            cut = int(np.searchsorted(number, (number[0] // width + 1) * width))
            # No block is empty, so that a tile with members of one block only is this block with itself.
            yield from work(table.slice(0, cut), table.slice(cut) if cut < len(number) else table, cut == len(number))

    return placed.mapInArrow(run, schema)


def _list(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the lists of a column, with the end, and all their values."""
    chunks = table.column(name).combine_chunks()
    chunks = chunks.chunk(0) if isinstance(chunks, pa.ChunkedArray) else chunks
    starts = chunks.offsets.to_numpy()
    return (starts - starts[0]).astype(np.int64), chunks.flatten().to_numpy()


def _ids(table: pa.Table, name: str) -> pa.Array:
    ids = table.column(name).combine_chunks()
    return ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids


def _spread(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low, low + 1, .. of each, n of them."""
    stop = np.cumsum(n)
    return np.arange(stop[-1] if len(n) else 0) + np.repeat(low - (stop - n), n)


def _pieces(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of about `most` in sum, or one that is larger by itself."""
    if not len(n):
        return
    piece = (np.cumsum(n) - n) // most
    cuts = [0, *(np.flatnonzero(piece[1:] != piece[:-1]) + 1), len(n)]
    yield from zip(cuts[:-1], cuts[1:], strict=True)


# Members with an equal mark -------------------------------------------------------------------------------------------


def _marked(left: pa.Table, right: pa.Table, own: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(left, rights): of each member of the left block those of the right one with which it has a mark in common."""
    la, ka = _list(left, "marks")
    lb, kb = (la, ka) if own else _list(right, "marks")
    ids, others, width = _ids(left, "id"), _ids(right, "id"), right.num_rows
    if max(ka.max(initial=0), kb.max(initial=0)) > CELLS or min(ka.min(initial=0), kb.min(initial=0)) < 0:
        every, place = np.unique(np.concatenate((ka, kb)), return_inverse=True)
        ka, kb, most = place[: len(ka)], place[len(ka) :], len(every)
    else:
        most = int(max(ka.max(initial=0), kb.max(initial=0))) + 1
    holder = np.repeat(np.arange(width, dtype=np.int32), np.diff(lb))[np.argsort(kb, kind="stable")]
    size = np.bincount(kb, minlength=most)
    start = np.cumsum(size) - size
    step = max(1, CELLS // width)
    for a in range(0, left.num_rows, step):
        b = min(a + step, left.num_rows)
        mine = ka[la[a] : la[b]]
        row, n, low = np.repeat(np.arange(b - a) * width, np.diff(la[a : b + 1])), size[mine], start[mine]
        mark = np.zeros((b - a) * width, bool)
        for p, q in _pieces(n, MOST):
            mark[np.repeat(row[p:q], n[p:q]) + holder[_spread(low[p:q], n[p:q])]] = True
        mark = mark.reshape(b - a, width)
        if own:
            mark &= np.arange(width) > np.arange(a, b)[:, None]
        found, other = np.count_nonzero(mark, axis=1), np.nonzero(mark)[1]
        rows = np.flatnonzero(found)
        if len(rows):
            rights = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(found[rows]))), pa.int32()), others.take(pa.array(other)))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows + a)), rights.cast(schema.field(1).type)], schema=schema)


def marked_pairs(members: DataFrame, block: int | None = None) -> DataFrame:
    """(left, right), left < right, each once: ids with a mark in common, of members (id, marks), marks being a list of integers, of which each id has one.

    A tile is marked, some rows at a time, in an array of its cells: a pair with many common marks is still one cell, and no pair is shuffled to be found equal to another.
    """
    kind = members.schema["id"].dataType
    schema = T.StructType([T.StructField("left", kind), T.StructField("rights", T.ArrayType(kind))])

    def work(left: pa.Table, right: pa.Table, own: bool) -> Iterator[pa.RecordBatch]:
        of = left.schema.field("id").type
        return _marked(left, right, own, pa.schema([("left", of), ("rights", pa.list_(of))]))

    found = tiled(members.select("id", "marks"), "id", block, work, schema)
    return found.select("left", F.explode("rights").alias("right"))


# Members with enough common groups ------------------------------------------------------------------------------------


class _Side:
    """The members of a block, with their groups in ascending order of size; `tail` are the last ones, that are not expanded."""

    def __init__(self, table: pa.Table, tail: int) -> None:
        self.ids, self.size, self.n = _ids(table, "id"), table.column("size").to_numpy(), table.num_rows
        at, group = _list(table, "groups")
        self.first, self.stop, self.group = at[:-1], at[1:], group.astype(np.int64)
        self.value = _list(table, "values")[1] if "values" in table.column_names else None
        self.marks = _list(table, "marks")[1].reshape(self.n, -1) if "marks" in table.column_names else None
        self.rest = np.maximum(self.stop - tail, self.first)
        self.keys = np.repeat(np.arange(self.n) << 32, self.stop - self.first) | self.group

    def place(self, member: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the members' rows of the groups are, and whether there are any."""
        key = (member << 32) | group
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, self.keys[at] == key


def _meeting(one: _Side, two: _Side, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, n): members that meet in n groups outside of both tails."""
    at = _spread(two.first, two.rest - two.first)
    order = np.argsort(two.group[at], kind="stable")
    group, holder = two.group[at][order], np.repeat(np.arange(two.n), two.rest - two.first)[order]
    mine = _spread(one.first, one.rest - one.first)
    low, high = (np.searchsorted(group, one.group[mine], side) for side in ("left", "right"))
    many = np.concatenate(([0], np.cumsum(high - low)))
    bound = np.concatenate(([0], np.cumsum(one.rest - one.first)))
    for a, b in _pieces(many[bound[1:]] - many[bound[:-1]], MOST):
        if b == a + 1:
            # One member, whatever it meets, is counted in an array of the block.
            count = np.zeros(two.n, np.int64)
            p, q = bound[a], bound[b]
            for x, y in _pieces((high - low)[p:q], MOST):
                count += np.bincount(holder[_spread(low[p + x : p + y], (high - low)[p + x : p + y])], minlength=two.n)
            j = np.flatnonzero(count)
            i, n = np.full(len(j), a), count[j]
        else:
            p, q = bound[a], bound[b]
            size = (high - low)[p:q]
            row = np.repeat(np.repeat(np.arange(a, b), one.rest[a:b] - one.first[a:b]), size)
            code, n = np.unique(row * two.n + holder[_spread(low[p:q], size)], return_counts=True)
            i, j = code // two.n, code % two.n
        if own:
            i, j, n = (x[i < j] for x in (i, j, n))
        if len(i):
            yield i, j, n


def _sums(one: _Side, two: _Side, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """sx, sy, sxx, syy, sxy of the pairs; the member with fewer groups is looked up in the other."""
    out = [np.zeros(len(i)) for _ in range(5)]
    fewer = one.stop[i] - one.first[i] <= two.stop[j] - two.first[j]
    for a, b, ia, jb, rows, turn in ((one, two, i, j, np.flatnonzero(fewer), (0, 1, 2, 3, 4)), (two, one, j, i, np.flatnonzero(~fewer), (1, 0, 3, 2, 4))):
        n = (a.stop - a.first)[ia[rows]]
        for p, q in _pieces(n, MOST):
            at, pair = _spread(a.first[ia[rows[p:q]]], n[p:q]), np.repeat(np.arange(q - p), n[p:q])
            place, hit = b.place(np.repeat(jb[rows[p:q]], n[p:q]), a.group[at])
            x, y, pair = a.value[at[hit]], b.value[place[hit]], pair[hit]
            for k, v in zip(turn, (x, y, x * x, y * y, x * y), strict=True):
                out[k][rows[p:q]] = np.bincount(pair, v, minlength=q - p)
    return out


def _sharing(one: _Side, two: _Side, own: bool, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(i, j, [n and the sums]) of the pairs with at least `least` common groups and, with marks, an equal one in the same place."""
    for i, j, n in _meeting(one, two, own):
        for t in range(1, least):
            # A group in the tail of the left member counts wherever the right one has it; one in the right one's, if it is not in the left one's.
            for a, b, x, y, whole in ((one, two, i, j, True), (two, one, j, i, False)):
                at = a.stop[x] - t
                has = at >= a.rest[x]
                place, hit = b.place(y, a.group[np.where(has, at, 0)])
                n = n + (has & hit & (whole | (place < b.rest[y])))
        enough = n >= least
        i, j, n = i[enough], j[enough], n[enough]
        if one.marks is not None:
            same = np.zeros(len(i), bool)
            for p in range(0, len(i), 1 << 16):
                same[p : p + (1 << 16)] = (one.marks[i[p : p + (1 << 16)]] == two.marks[j[p : p + (1 << 16)]]).any(axis=1)
            i, j, n = i[same], j[same], n[same]
        if len(i):
            yield i, j, [n, *(_sums(one, two, i, j) if one.value is not None else [])]


def sharing_pairs(rows: DataFrame, least: int, marks: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """(left, right, left_size, right_size, n) and, if the rows (m, g, v) have a v, sx, sy, sxx, syy, sxy, x being the left member's: pairs left < right with at least
    `least` common groups, least > 1, and all their members' numbers of groups. Rows are distinct in (m, g) and without nulls. With marks (m, marks), lists
    of integers of one length, only pairs with an equal one in the same place.

    Groups are ordered by size, and each member leaves out its least - 1 largest when a tile looks for pairs that meet: the smallest group that a pair of `least`
    common ones shares is among the others of both. What meets is then looked up in what was left out, and the sums are made of the members' own rows.
    """
    if least < 2:
        raise ValueError("least must be above 1")
    valued = "v" in rows.columns
    rows = written(rows, "rows")
    groups = rows.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select(F.struct("k", "g").alias("s"))
    groups = dense_index(groups, "s", "number").select(F.col("s.g").alias("g"), F.col("number").cast("int").alias("number"))
    # Groups of one member are nobody's common ones; they count in its size.
    entry = F.struct("number", "v") if valued else F.struct("number")
    members = rows.join(groups, "g", "left").groupBy(F.col("m").alias("id"))
    members = members.agg(F.count("*").alias("size"), F.array_sort(F.collect_list(F.when(F.col("number").isNotNull(), entry))).alias("e")).where(F.size("e") >= least)
    columns = ["id", "size", F.col("e.number").alias("groups"), *([F.col("e.v").alias("values")] if valued else [])]
    members = members.select(*columns)
    if marks is not None:
        members = members.join(marks.select(F.col("m").alias("id"), "marks"), "id")
    kind = rows.schema["m"].dataType
    sums = ["sx", "sy", "sxx", "syy", "sxy"] if valued else []
    fields = [("left", kind), ("right", kind), *((c, T.LongType()) for c in ("left_size", "right_size", "n")), *((c, T.DoubleType()) for c in sums)]

    def work(left: pa.Table, right: pa.Table, own: bool) -> Iterator[pa.RecordBatch]:
        one = _Side(left, least - 1)
        two = one if own else _Side(right, least - 1)
        for i, j, more in _sharing(one, two, own, least):
            columns = [one.ids.take(pa.array(i)), two.ids.take(pa.array(j)), *map(pa.array, (one.size[i], two.size[j], *more))]
            yield pa.RecordBatch.from_arrays(columns, names=[f[0] for f in fields])

    return tiled(members, "id", block, work, T.StructType([T.StructField(*f) for f in fields]), WIDE)
