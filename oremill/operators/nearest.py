"""Ratings predicted from the nearest users, block by block: a task holds some users with all their neighbours and both sides' ratings, and finishes their predictions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oremill.functions.shared import discard, written
from oremill.operators.tiles import MOST, PARTITIONS, _ids, _list, _pieces, _spread, dense_index

#: About as many neighbours in a block of users; fewer are cut into up to FEW blocks of about LEAST, so that there are blocks for all cores.
BLOCK, FEW, LEAST = 500_000, 8, 20_000


class _Lists:
    """The users of a block and their neighbours, in the order of their ids, with what they rated or want, in the order of the businesses."""

    def __init__(self, table: pa.Table) -> None:
        table = table.take(pc.sort_indices(_ids(table, "id")))
        self.ids = _ids(table, "id")
        at, self.item = _list(table, "items")
        self.first, self.size, self.item = at[:-1], np.diff(at), self.item.astype(np.int64)
        self.stars, self.wanted = _list(table, "stars")[1], _list(table, "wanted")[1] != 0
        self.rated = ~np.isnan(self.stars)
        owner = np.repeat(np.arange(len(self.ids)), self.size)
        self.keys = owner << 32 | self.item
        self.count = np.bincount(owner, self.rated, len(self.ids))
        self.sum = np.bincount(owner, np.where(self.rated, self.stars, 0), len(self.ids))

    def common(self, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(pair, of_i, of_j): where pairs i, j have the same business; the shorter list is looked up in the other."""
        turn = self.size[i] > self.size[j]
        few, many = np.where(turn, j, i), np.where(turn, i, j)
        for p, q in _pieces(self.size[few], MOST):
            n = self.size[few[p:q]]
            at, pair = _spread(self.first[few[p:q]], n), np.repeat(np.arange(p, q), n)
            key = many[pair] << 32 | self.item[at]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            pair, at, place = pair[hit], at[hit], place[hit]
            yield pair, np.where(turn[pair], place, at), np.where(turn[pair], at, place)


def _highest(user: np.ndarray, item: np.ndarray, sim: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """The k rows of each user and item with the highest sim, ties by the other, together. NaN is the highest and null, here -inf, the lowest."""
    order = np.lexsort((other, -sim, ~np.isnan(sim), item, user))
    u, b = user[order], item[order]
    new = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (b[1:] != b[:-1])))[: len(order)])
    return order[np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order)))) < k]


def _block(table: pa.Table, k: int, least: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(users, items, stars) that are predicted."""
    links, held = table.filter(table.column("link")), table.filter(pc.invert(table.column("link")))
    if not links.num_rows or not held.num_rows:
        return
    lists = _Lists(held)
    one, two = (pc.index_in(_ids(links, c), lists.ids).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "other"))
    null = pc.is_null(_ids(links, "sim")).to_numpy(zero_copy_only=False)
    sim = np.where(null, -np.inf, pc.fill_null(_ids(links, "sim"), 0.0).to_numpy(zero_copy_only=False))
    kept = np.flatnonzero((one >= 0) & (two >= 0))
    kept = kept[np.argsort(one[kept], kind="stable")]
    i, j, sim = one[kept], two[kept], sim[kept]
    cuts = np.concatenate(([0], np.flatnonzero(i[1:] != i[:-1]) + 1, [len(i)])) if len(i) else np.zeros(1, np.int64)
    work = np.concatenate(([0], np.cumsum(np.minimum(lists.size[i], lists.size[j]))))
    # Whole users, so that their neighbours meet here; one with very many is a piece of its own, in which only the best so far are held.
    for a, b in _pieces(np.diff(work[cuts]), MOST):
        p, q = cuts[a], cuts[b]
        both, total = np.zeros(q - p), np.zeros(q - p)
        found = [np.zeros(0, np.int64)] * 2
        for pair, x, y in lists.common(i[p:q], j[p:q]):
            shared = lists.rated[x] & lists.rated[y]
            both += np.bincount(pair[shared], minlength=q - p)
            total += np.bincount(pair[shared], lists.stars[y[shared]], minlength=q - p)
            met = lists.wanted[x] & lists.rated[y]
            found = [np.concatenate(z) for z in zip(found, (pair[met], y[met]), strict=True)]
            best = _highest(i[p:q][found[0]], lists.item[found[1]], sim[p:q][found[0]], j[p:q][found[0]], k)
            found = [z[best] for z in found]
        pair, y = found
        rated = both[pair] > 0
        pair, y = pair[rated], y[rated]
        if not len(pair):
            continue
        user, item, weight = i[p:q][pair], lists.item[y], sim[p:q][pair]
        new = np.flatnonzero(np.concatenate(([True], (user[1:] != user[:-1]) | (item[1:] != item[:-1]))))
        group = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(user))))
        weight = np.where(np.isneginf(weight), 0.0, weight)
        below = np.bincount(group, weight)
        with np.errstate(invalid="ignore", divide="ignore"):
            shift = np.bincount(group, (lists.stars[y] - total[pair] / both[pair]) * weight) / below
            stars = lists.sum[user[new]] / lists.count[user[new]] + shift
        good = (np.bincount(group) >= least) & (below != 0) & (lists.count[user[new]] > 0)
        yield lists.ids.take(pa.array(user[new][good])), item[new][good], stars[good]


def predicted(pairs: DataFrame, ratings: DataFrame, model: DataFrame, k: int, least: int, blocks: int | None = None) -> DataFrame:
    """(user_id, business_id, stars) as cf.predict_user_based, not rounded, of pairs (user_id, business_id), ratings with one row of each pair, and (u1, u2, sim).

    Users are cut into blocks by hash. A block gets the model's rows of its users and one list of ratings of every user and neighbour in it, so that neither
    a user's wanted businesses times its neighbours nor the ratings that they share are ever shuffled; only finished predictions leave a block.
    """
    model = written(model.select("u1", "u2", F.col("sim").cast("double").alias("sim")).where("u1 is not null and u2 is not null"), "model")
    count = 2 * model.count()
    blocks = min(PARTITIONS, blocks or max(1, min(FEW, -(-count // LEAST)), -(-count // BLOCK)))
    wanted = pairs.select("user_id", "business_id", F.lit(None).cast("double").alias("stars"), F.lit(1).alias("wanted")).where("user_id is not null and business_id is not null")
    held = ratings.select("user_id", "business_id", "stars", F.lit(0).alias("wanted")).unionByName(wanted)
    held = written(held.groupBy("user_id", "business_id").agg(F.max("stars").alias("stars"), F.max("wanted").cast("tinyint").alias("wanted")), "held")
    numbers = dense_index(held, "business_id", "item")
    entry = F.struct(F.col("item").cast("int").alias("item"), F.coalesce("stars", F.lit(float("nan"))).alias("stars"), "wanted")
    lists = held.join(numbers, "business_id").groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    lists = written(lists.select("id", F.col("e.item").alias("items"), F.col("e.stars").alias("stars"), F.col("e.wanted").alias("wanted")), "lists")
    discard(held)
    one, two = F.struct(F.col("u1").alias("id"), F.col("u2").alias("other"), "sim"), F.struct(F.col("u2").alias("id"), F.col("u1").alias("other"), "sim")
    near = model.select(F.explode(F.array(one, two)).alias("r")).select("r.*")
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("_block")
    needed = near.select(block, F.explode(F.array("id", "other")).alias("id")).distinct().join(lists, "id")
    # No nulls but in `sim`: Spark takes time in the square of a batch's rows to write null lists and texts for Python.
    none = [F.array().cast(lists.schema[c].dataType).alias(c) for c in ("items", "stars", "wanted")]
    links = near.select(block, F.lit(True).alias("link"), "id", "other", "sim", *none)
    placed = links.union(needed.select("_block", F.lit(False), "id", "id", F.lit(0.0), "items", "stars", "wanted"))
    placed = placed.repartitionById(blocks, "_block").drop("_block")  # a partition is one block
    kind = model.schema["u1"].dataType
    schema = T.StructType([T.StructField("user_id", kind), T.StructField("item", T.LongType()), T.StructField("stars", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if held:
            for users, items, stars in _block(pa.Table.from_batches(held), k, least):
                yield pa.RecordBatch.from_arrays([users, pa.array(items), pa.array(stars)], names=["user_id", "item", "stars"])

    return placed.mapInArrow(run, schema).join(numbers, "item").select("user_id", "business_id", "stars")
