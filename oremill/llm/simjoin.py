"""Pairs of records whose sets overlap."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oremill.functions.shared import written
from oremill.llm.blocks import block_pairs, runs, starts_of

#: Minhash values of a tree's signature, 16 bits of each, so that a signature is one number whose order is the lexicographic one.
DEPTH = 4


def depth_for(trees: int, threshold: float, recall: float) -> int:
    """From the deepest common prefix upward, the first at which a pair at the threshold meets in some tree with at least the target recall."""
    for depth in range(DEPTH, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    raise ValueError(f"{trees} trees can't reach a recall of {recall} at {threshold}")


def _least_agreement(trees: int, threshold: float, miss: float = 2e-6) -> int:
    """Of the two-bit fields of two sketches, the number that a pair at the threshold has equal but for the probability `miss`."""
    n, p = trees * DEPTH, threshold + (1 - threshold) / 4
    below, k = 0.0, 0
    while below + (term := comb(n, k) * p**k * (1 - p) ** (n - k)) < miss:
        below, k = below + term, k + 1
    return k


def _fitting(i: np.ndarray, j: np.ndarray, size: np.ndarray, sketch: np.ndarray, ratio: float, differ: int) -> np.ndarray:
    """Whether sizes and sketches of the pairs allow the threshold."""
    fit = np.flatnonzero(np.minimum(size[i], size[j]) >= ratio * np.maximum(size[i], size[j]))
    bits = sketch[i[fit]] ^ sketch[j[fit]]
    unequal = np.bitwise_count((bits | (bits >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1, dtype=np.int64)
    return fit[unequal <= differ]


def _neighbours(batches: Iterator[pa.RecordBatch], ratio: float, differ: int) -> Iterator[pa.RecordBatch]:
    """Of rows (tree, prefix, left_block, right_block, signature, block, member, size, sketch) in the order of the first five: every row with its neighbours at
    distance 1, 2, .. in the order, as long as they have its prefix. Those that fit come out, each pair once a table."""
    schema = pa.schema([("left", pa.int64()), ("right", pa.int64())])
    for table in runs(batches, 4):
        tree, prefix, left_block, right_block, _, block, member, size = (table.column(i).to_numpy() for i in range(8))
        sketch = np.frombuffer(b"".join(table.column(8).to_pylist()), np.uint64).reshape(len(tree), -1)
        starts = starts_of(tree, prefix, left_block, right_block)
        stop = np.repeat(starts[1:], np.diff(starts))
        across = left_block != right_block
        found: list[np.ndarray] = []
        at, distance = np.arange(len(tree)), 1
        while len(at := at[at + distance < stop[at]]):
            for a in range(0, len(at), 500_000):
                i = at[a : a + 500_000]
                i = i[~across[i] | (block[i] != block[i + distance])]
                i = i[_fitting(i, i + distance, size, sketch, ratio, differ)]
                if len(i):
                    x, y = member[i], member[i + distance]
                    found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
            if sum(map(len, found)) > 2_000_000:
                pairs = np.unique(np.concatenate(found), axis=0)
                found = []
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)
            distance += 1
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)


def similar_sets(rows: DataFrame, record: str = "business_id", value: str = "user_id", threshold: float = 0.5, least_size: int = 3, trees: int = 40, recall: float = 0.9999, block_rows: int = 4096) -> DataFrame:
    """Pairs of records whose value sets have a Jaccard similarity of at least `threshold`: (b1, b2, c, n1, n2, sim), b1 < b2.

    Repeated rows count once, rows with a null are left out; sets below `least_size` are left out. An empty table gives no rows.

    Sorted sketch forest: in each tree a record has a signature of DEPTH minhash values by the tree's own hash functions. Rows are ranged and sorted by tree and
    signature, lexicographically, and every row is compared with its neighbours in the order as far as their common prefix reaches: the
    prefix starts at the full depth and gets shorter until a pair at the threshold meets in one of the trees with probability `recall`
    (two of four values for 40 trees, 0.5 and 0.9999). Neighbours whose sizes or sketches - two bits of every minhash value - exclude the
    threshold drop out (a pair at the threshold is lost in the sketch with probability 2e-6); the rest are verified exactly on the sets.
    A prefix of more than `block_rows` rows, whatever the number of records, is cut into blocks of that size, and every pair of its blocks is searched
    by itself; so no prefix is dropped or comes together in one task.
    """
    rows = rows.select(F.col(record).alias("record"), F.col(value).alias("value")).where("record is not null and value is not null")
    rows = written(rows.distinct(), "sets")
    depth = depth_for(trees, threshold, recall)
    hashes = trees * DEPTH
    # Values are hashed to 64 bits once, and from there to 32 bits a function, which halves what the minima weigh.
    low = [F.min(F.hash("hashed", F.lit(i))).alias(f"h{i}") for i in range(hashes)]
    sizes = rows.select("record", F.xxhash64("value").alias("hashed")).groupBy("record").agg(F.count("*").alias("size"), *low).where(F.col("size") >= least_size)
    h = lambda i: F.col(f"h{i}").cast("bigint")
    whole = lambda t: [F.shiftleft(h(t * DEPTH + d).bitwiseAND(F.lit(0xFFFF)), 16 * (DEPTH - 1 - d)) for d in range(DEPTH)]
    signatures = F.array(*(_joined(whole(t)) for t in range(trees)))
    # Bits 16 and 17 of each value, 32 values a number; the signature has the bits below.
    fields = [F.shiftleft(F.shiftright(h(i), 16).bitwiseAND(F.lit(3)), 2 * (i % 32)) for i in range(hashes)]
    sketch = F.unhex(F.concat(*(F.lpad(F.hex(_joined(fields[i : i + 32])), 16, "0") for i in range(0, hashes, 32))))
    forest = sizes.select("record", F.col("size").cast("int").alias("size"), sketch.alias("sketch"), signatures.alias("signatures"))
    # Members are numbered in any order; written, so that a rerun task can't change the numbers.
    forest = written(forest.withColumn("member", F.monotonically_increasing_id()), "forest")
    placed = forest.select("member", "size", "sketch", F.posexplode("signatures").alias("tree", "signature"))
    prefix = F.shiftright("signature", 16 * (DEPTH - depth))
    placed = placed.withColumn("prefix", prefix)
    crowded = placed.groupBy("tree", "prefix").agg(F.count("*").alias("k")).where(F.col("k") > block_rows)
    crowded = written(crowded.select("tree", "prefix", F.ceil(F.col("k") / block_rows).cast("int").alias("pieces")), "crowded")
    spread = block_pairs(placed.join(crowded, ["tree", "prefix"], "left"), "member", F.coalesce("pieces", F.lit(1)))
    group = ["tree", "prefix", "left_block", "right_block"]
    spread = spread.select(*group, "signature", "block", "member", "size", "sketch")
    spread = spread.repartitionByRange(*group).sortWithinPartitions(*group, "signature")
    part = Fraction(threshold).limit_denominator(10_000)
    differ = hashes - _least_agreement(trees, threshold)
    near = spread.mapInArrow(lambda b: _neighbours(b, float(part), differ), "left bigint, right bigint").distinct()
    # Exact check: walk the smaller set and look its values up in the larger one.
    names = forest.select("member", "record", "size")
    sides = near.join(names.select(F.col("member").alias("left"), F.col("record").alias("x"), F.col("size").alias("nx")), "left")
    sides = sides.join(names.select(F.col("member").alias("right"), F.col("record").alias("y"), F.col("size").alias("ny")), "right")
    first = F.col("x") < F.col("y")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    sides = written(sides.select(pick("x", "y").alias("b1"), pick("y", "x").alias("b2"), pick("nx", "ny").alias("n1"), pick("ny", "nx").alias("n2")), "near")
    walk = sides.withColumn("record", F.when(F.col("n1") <= F.col("n2"), F.col("b1")).otherwise(F.col("b2")))
    walk = walk.withColumn("other", F.when(F.col("n1") <= F.col("n2"), F.col("b2")).otherwise(F.col("b1")))
    met = walk.join(rows, "record").join(rows.select(F.col("record").alias("other"), "value"), ["other", "value"])
    counts = met.groupBy("b1", "b2", "n1", "n2").agg(F.count("*").alias("c"))
    fits = F.col("c") * part.denominator >= part.numerator * (F.col("n1") + F.col("n2") - F.col("c"))
    return counts.where(fits).select("b1", "b2", "c", "n1", "n2", (F.col("c") / (F.col("n1") + F.col("n2") - F.col("c"))).alias("sim"))


def _joined(parts: list[Column]) -> Column:
    out = parts[0]
    for x in parts[1:]:
        out = out.bitwiseOR(x)
    return out
