"""The N best items of every group, by merging sorted runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oremill.functions.shared import written

_SCHEMA = pa.schema([("grp", pa.string()), ("bucket", pa.int32()), ("run", pa.int64()), ("score", pa.float64()), ("item", pa.string())])
_COLUMNS = "grp string, bucket int, run bigint, score double, item string"


class LoserTree:
    """Tournament over sorted runs. pop() gives the least head; the path of its run is then replayed against the losers kept in the
    inner nodes, so that an output costs log2(runs) comparisons."""

    def __init__(self, lists: list[list[tuple]]) -> None:
        self.lists = lists
        self.at = [0] * len(lists)
        self.k = max(1, len(lists))
        self.loser = [-1] * self.k
        winner = [-1] * (2 * self.k)
        for r in range(len(lists)):
            winner[self.k + r] = r
        for node in range(self.k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            first = self._first(a, b)
            winner[node], self.loser[node] = first, a + b - first
        self.winner = winner[1] if self.k > 1 else (0 if lists else -1)

    def _head(self, r: int) -> tuple | None:
        return self.lists[r][self.at[r]] if 0 <= r and self.at[r] < len(self.lists[r]) else None

    def _first(self, a: int, b: int) -> int:
        x, y = self._head(a), self._head(b)
        return a if y is None or x is not None and x <= y else b

    def pop(self) -> tuple | None:
        r = self.winner
        head = self._head(r)
        if head is None:
            return None
        self.at[r] += 1
        node = (self.k + r) // 2
        while node:
            first = self._first(r, self.loser[node])
            if first != r:
                r, self.loser[node] = self.loser[node], r
            node //= 2
        self.winner = r
        return head


def _first_of(items: list[str], n: int, seen: set[str]) -> list[int]:
    """Places of the items that are not in `seen`, which takes them in, until it has n."""
    out = []
    for at, x in enumerate(items):
        if len(seen) >= n:
            break
        if x not in seen:
            seen.add(x)
            out.append(at)
    return out


def _cut(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Of a run sorted by (grp, score desc, item): the first n different items of each group; from there it seeks to where the next group starts, so
    that rows behind a group's first ones are not looked at."""
    last, seen = None, set()
    for b in batches:
        rows = b.num_rows
        if not rows:
            continue
        grp, item = b.column(0), b.column(4)
        starts = np.concatenate(([0], np.flatnonzero(pc.not_equal(grp.slice(1), grp.slice(0, rows - 1)).to_numpy(zero_copy_only=False)) + 1, [rows]))
        keep: list[np.ndarray] = []
        first = 0
        if grp[0].as_py() == last:
            # The group goes on from the batch before.
            keep.append(np.array(_first_of(item.slice(0, int(starts[1])).to_pylist(), n, seen) if len(seen) < n else [], np.int64))
            first = 1
        begin, stop = starts[first:-1], starts[first + 1 :]
        length = np.minimum(stop - begin, n)
        front = np.repeat(begin, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        owner = np.repeat(np.arange(len(begin)), length)
        # Groups whose first rows repeat an item, with another score or the same, are walked on; others are cut as they are.
        items = item.take(pa.array(front)).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((items, owner))
        same = (owner[order][1:] == owner[order][:-1]) & (items[order][1:] == items[order][:-1])
        repeated = np.unique(owner[order][1:][same])
        keep.append(front[~np.isin(owner, repeated)])
        for g in repeated:
            walked, at = set(), int(begin[g])
            while at < stop[g] and len(walked) < n:
                size = min(64 * n, int(stop[g]) - at)
                keep.append(at + np.array(_first_of(item.slice(at, size).to_pylist(), n, walked), np.int64))
                at += size
        if len(begin):
            last, seen = grp[rows - 1].as_py(), set()
            kept = np.concatenate(keep)
            seen.update(item.take(pa.array(kept[kept >= begin[-1]])).to_pylist())
        rows_kept = np.sort(np.concatenate(keep))
        yield b.take(pa.array(rows_kept)).cast(_SCHEMA)


def _merge(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (grp, bucket, run, score desc, item): merge each group's runs until n different items came out."""
    held: tuple[list, ...] = ([], [], [], [], [])

    def close(at: tuple, lists: list[list[tuple]]) -> None:
        tree = LoserTree(lists)
        seen: set[str] = set()
        while len(seen) < n and (head := tree.pop()):
            if head[1] not in seen:
                seen.add(head[1])
                for column, x in zip(held, (at[0], 0, at[1], -head[0], head[1]), strict=True):
                    column.append(x)

    def taken() -> pa.RecordBatch:
        nonlocal held
        out, held = held, ([], [], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _SCHEMA.types, strict=True)], schema=_SCHEMA)

    at, run, lists = None, None, []
    for b in batches:
        for grp, bucket, r, score, item in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if (grp, bucket) != at:
                if at is not None:
                    close(at, lists)
                at, run, lists = (grp, bucket), None, []
            if r != run:
                run = r
                lists.append([])
            lists[-1].append((-score, item))
        if len(held[0]) > 20_000:
            yield taken()
    if at is not None:
        close(at, lists)
    yield taken()


def top_items(rows: DataFrame, group: str, item: str, score: str, n: int = 5, fan_in: int = 64) -> DataFrame:
    """The n items of every group with the highest scores: (grp, item, score); ties go to the smaller item.

    Rows with a null group, item or score, or a NaN score, are left out; an item given more than once has its highest score (-0.0 counts
    as 0.0). A group with fewer items has fewer rows; an empty table none.

    Sorted-run merge: every input partition is sorted by group and score into a run, which keeps n items a group and seeks to the next group; the runs are
    stored in the shared folder, by the bucket in which they are merged. A loser tree merges at most `fan_in` runs: with more of them they first meet in
    several buckets, whose winners are stored as runs again. So a group's rows never come together beyond n * fan_in, however many it has.
    """
    clean = rows.select(F.col(group).alias("grp"), F.col(item).alias("item"), (F.col(score).cast("double") + F.lit(0.0)).alias("score"))
    clean = clean.where("grp is not null and item is not null and score is not null and not isnan(score)")
    runs = clean.sortWithinPartitions("grp", F.desc("score"), "item")
    runs = runs.select("grp", F.lit(0).alias("bucket"), F.spark_partition_id().cast("bigint").alias("run"), "score", "item")
    best = runs.mapInArrow(lambda b: _cut(b, n), _COLUMNS)
    count = max(1, clean.rdd.getNumPartitions())
    while True:
        buckets = -(-count // fan_in)
        best = written(best.withColumn("bucket", F.pmod("run", F.lit(buckets)).cast("int")), "runs", ["bucket"] if buckets > 1 else None).select("grp", "bucket", "run", "score", "item")
        best = best.repartition("grp", "bucket").sortWithinPartitions("grp", "bucket", "run", F.desc("score"), "item")
        best = best.mapInArrow(lambda b: _merge(b, n), _COLUMNS)
        if buckets == 1:
            break
        count = buckets
    return best.select("grp", "item", "score")
