"""Pairs within groups, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_pairs(df: DataFrame, member: str, pieces: Column) -> DataFrame:
    """Spread every group over `pieces` blocks and hand each member to all pairs of blocks (left_block <= right_block) with its own.

    Any two members of a group then meet in exactly one pair of blocks: that of their blocks. `block` is the member's own.
    """
    df = df.withColumn("_pieces", F.greatest(F.lit(1), pieces).cast("int"))
    df = df.withColumn("block", F.pmod(F.xxhash64(F.col(member), F.lit(7)), F.col("_pieces")).cast("int"))
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
    left, right = F.least("block", "_other"), F.greatest("block", "_other")
    return df.withColumn("left_block", left).withColumn("right_block", right).drop("_pieces", "_other")


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups: batches sorted by their first `keys` columns are cut only where one of these changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for i in range(keys):
            column = batch.column(i).to_numpy(zero_copy_only=False)
            change |= column[1:] != column[:-1]
        last = int(np.flatnonzero(change)[-1]) + 1 if change.any() else 0
        if held and (last or any(held[-1].column(i)[-1] != batch.column(i)[0] for i in range(keys))):
            if any(held[-1].column(i)[-1] != batch.column(i)[0] for i in range(keys)):
                yield pa.Table.from_batches(held)
                held = []
        if last:
            # Up to the last change; what was held belongs to the first group here.
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where groups of equal adjacent rows begin, with the number of rows at the end."""
    n = len(columns[0])
    change = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    return np.concatenate(([0], np.flatnonzero(change) + 1, [n])) if n else np.zeros(1, np.int64)
