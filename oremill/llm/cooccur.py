"""Items that occur together in baskets more often than chance."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oremill.functions.shared import written
from oremill.llm.blocks import runs, starts_of
from oremill.operators.similarity import dense_index

_COUNTS = pa.schema([("left", pa.int64()), ("right", pa.int64()), ("c", pa.int64())])


def tile_product(record: np.ndarray, item: np.ndarray, left_block: int, right_block: int, width: int, most: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """The product of two sparse 0/1 matrices, records by the items of the left block, transposed, and records by those of the right one: (codes, counts) of
    its entries above 0, a code being left item * width + right item, counted within the blocks. Of a block with itself the upper triangle.

    Rows are sorted by record and item, so that a record's items of the left block are in front. A record adds the outer product of its two
    rows; those of successive records are added up together, about `most` entries at a time, in an array as large as the tile or, when
    there are few, by sorting. A record has at most width * width entries.
    """
    own = left_block == right_block
    local = item - np.where(item // width == left_block, left_block, right_block) * width
    starts = starts_of(record)
    first, stop = starts[:-1], starts[1:]
    lefts = np.concatenate(([0], np.cumsum(item // width == left_block)))
    middle = first + lefts[stop] - lefts[first]
    begin = first if own else middle  # of the right row
    nl, nr = middle - first, stop - begin
    entries = nl * nr
    chunk = (np.cumsum(entries) - entries) // most
    codes: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    dense: np.ndarray | None = None
    for a, b in zip((s := starts_of(chunk))[:-1], s[1:], strict=True):
        n = entries[a:b]
        at = np.repeat(np.arange(a, b), n)
        if not len(at):
            continue
        within = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        i, j = local[first[at] + within // nr[at]], local[begin[at] + within % nr[at]]
        if own:
            upper = i < j
            i, j = i[upper], j[upper]
        code = i * width + j
        if len(code) * 16 > width * width:
            dense = np.bincount(code, minlength=width * width) if dense is None else dense + np.bincount(code, minlength=width * width)
        else:
            c, k = np.unique(code, return_counts=True)
            codes.append(c)
            counts.append(k)
    if dense is not None:
        codes.append(np.flatnonzero(dense))
        counts.append(dense[codes[-1]])
    if len(codes) < 2:
        return (codes[0], counts[0]) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    code, count = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, count = code[order], count[order]
    at = starts_of(code)[:-1]
    return code[at], np.add.reduceat(count, at)


def _gram(batches: Iterator[pa.RecordBatch], width: int, least: int) -> Iterator[pa.RecordBatch]:
    """Of rows (left_block, right_block, part, record, item) in that order: the entries of every tile's product that reach `least`, (left, right, c)."""
    held: list[list[np.ndarray]] = [[], [], []]
    for table in runs(batches, 3):
        left_block, right_block, part, record, item = (table.column(i).to_numpy() for i in range(5))
        starts = starts_of(left_block, right_block, part)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            lb, rb = int(left_block[a]), int(right_block[a])
            code, c = tile_product(record[a:b], item[a:b], lb, rb, width)
            enough = c >= least
            for column, x in zip(held, (code[enough] // width + lb * width, code[enough] % width + rb * width, c[enough]), strict=True):
                column.append(x)
        if sum(map(len, held[0])) > 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in held], schema=_COUNTS)
            held = [[], [], []]
    if held[0]:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in held], schema=_COUNTS)


def _exact(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(18,0)")


def item_pairs(baskets: DataFrame, basket: str = "user_id", item: str = "business_id", least: int = 5, lift: float | None = None, block_items: int = 2048, part_rows: int = 2_000_000) -> DataFrame:
    """Pairs of items that at least `least` baskets hold: (b1, b2, c, n1, n2, lift), b1 < b2, c * N / (n1 * n2) being the lift.

    Repeated rows count once, rows with a null are left out; N counts all baskets. With `lift`, only pairs with c * N >= lift * n1 * n2, compared exactly.
    An empty table gives no rows.

    Blocked Gram matrix: items are numbered and cut into blocks of `block_items` numbers, the same for all baskets, and baskets into parts that hold about
    `part_rows` rows each. A basket's items go to the tiles (left block, right block, part) of the blocks that it touches. A task multiplies, for each of its
    tiles, the transposed sparse 0/1 matrix of the left block with that of the right one; the products of the parts are then added up. The counts are
    normalised by the marginals. Items in fewer than `least` baskets can't be in a pair, nor, as c <= the smaller n, items in more than N / lift; they
    are left out before. A tile has at most about part_rows rows, and a basket at most block_items^2 pairs in it, however large the basket or frequent an item.
    """
    rows = baskets.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket is not null and item is not null")
    rows = written(rows.distinct(), "baskets")
    total = rows.agg(F.count_distinct("basket")).first()[0]
    marginal = rows.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    if lift:
        marginal = marginal.where(F.col("n") * F.lit(float(lift)) <= total)
    marginal = written(marginal, "marginals")
    numbers = dense_index(marginal, "item", "number")
    marginal = written(marginal.join(numbers, "item"), "numbered")
    kept = written(rows.join(marginal.select("item", "number"), "item").select("basket", "number"), "kept")
    # A basket's number need only be its own; written, so that a rerun task can't change it.
    touched = kept.groupBy("basket").agg(F.count("*").alias("size"), F.collect_set(F.floor(F.col("number") / block_items).cast("int")).alias("blocks")).where("size > 1")
    touched = written(touched.withColumn("record", F.monotonically_increasing_id()), "touched")
    parts = max(1, -(-(touched.agg(F.sum("size")).first()[0] or 0) // part_rows))
    own, other = F.floor(F.col("number") / block_items).cast("int"), F.col("other")
    placed = kept.join(touched.select("basket", "record", "blocks"), "basket").select("record", "number", F.explode("blocks").alias("other"))
    placed = placed.select(F.least(own, other).alias("left_block"), F.greatest(own, other).alias("right_block"), F.pmod(F.xxhash64("record"), F.lit(parts)).cast("int").alias("part"), "record", F.col("number").alias("item"))
    tile = ["left_block", "right_block", "part"]
    placed = placed.repartition(*tile).sortWithinPartitions(*tile, "record", "item")
    # With one part a tile's counts are whole; else any of them may be part of a sufficient one.
    enough = least if parts == 1 else 1
    counts = placed.mapInArrow(lambda batches: _gram(batches, block_items, enough), "left bigint, right bigint, c bigint")
    counts = counts.groupBy("left", "right").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    side = lambda s: marginal.select(F.col("number").alias("left" if s == 1 else "right"), F.col("item").alias(f"b{s}"), F.col("n").alias(f"n{s}"))
    pairs = counts.join(side(1), "left").join(side(2), "right").drop("left", "right")
    pairs = pairs.withColumn("lift", F.col("c") * F.lit(float(total)) / (F.col("n1") * F.col("n2")))
    if lift:
        ratio = Fraction(lift).limit_denominator(10_000)
        pairs = pairs.where(_exact("c") * _exact(F.lit(total)) * F.lit(ratio.denominator) >= _exact("n1") * _exact("n2") * F.lit(ratio.numerator))
    return pairs.select("b1", "b2", "c", "n1", "n2", "lift")
