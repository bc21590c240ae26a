"""Members that share groups: counts and sums over what they share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oremill.operators.tiles import sharing_pairs

#: Most rows of a group that are paired in one piece of work; larger groups are cut into blocks of about this size.
BLOCK = 1000


def met(rows: DataFrame, keys: list[str], member: str, carried: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """Pairs of members with equal keys: (keys.., left, right, left_c, right_c for each carried column c), left < right, once for every key they share.

    A key of more than `block` rows is cut into blocks of about that size by a hash of the member, and every pair of its blocks is a join key of its own:
    no key's pairs come together in one task, and no join key has more than about block * block pairs. Rows with a null key meet nothing.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_k")).where(F.col("_k") > block).select(*keys, F.ceil(F.col("_k") / block).cast("int").alias("_pieces"))
    placed = rows.join(sizes, keys, "left").withColumn("_pieces", F.coalesce("_pieces", F.lit(1)))
    placed = placed.withColumn("_own", F.pmod(F.xxhash64(F.col(member), F.lit(7)), F.col("_pieces")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))
    one = placed.select(*keys, F.col("_own").alias("_a"), every.alias("_b"), F.col(member).alias("left"), *(F.col(c).alias(f"left_{c}") for c in carried))
    two = placed.select(*keys, every.alias("_a"), F.col("_own").alias("_b"), F.col(member).alias("right"), *(F.col(c).alias(f"right_{c}") for c in carried))
    return one.join(two, [*keys, "_a", "_b"]).where(F.col("left") < F.col("right")).drop("_a", "_b")


def _sums(value: str | None) -> list:
    sums = [F.count("*").alias("n")]
    if value:
        x, y = F.col("left_v"), F.col("right_v")
        sums += [F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy")]
    return sums


def shared_by(pairs: DataFrame, rows: DataFrame, member: str, group: str, value: str | None = None) -> DataFrame:
    """(left, right, n) and with a value sx, sy, sxx, syy, sxy, as shared_groups, of given distinct pairs (left, right) only; pairs without a common group drop out."""
    more = [F.col(value).cast("double").alias("v")] if value else []
    rows = rows.select(F.col(member).alias("m"), F.col(group).alias("g"), *more)
    one = rows.withColumnsRenamed({"m": "left", "v": "left_v"})
    two = rows.withColumnsRenamed({"m": "right", "v": "right_v"})
    return pairs.select("left", "right").join(one, "left").join(two, ["right", "g"]).groupBy("left", "right").agg(*_sums(value))


def shared_groups(rows: DataFrame, member: str, group: str, least: int = 1, value: str | None = None, block: int = BLOCK) -> DataFrame:
    """Pairs of members with at least `least` common groups: (left, right, n) with left < right; with a value also the sums sx, sy, sxx, syy, sxy
    over the common groups, x being the left member's. rows has distinct (member, group) without nulls.

    With least = 1 every pair of a group is a result, and is counted group by group, in blocks (see met). Otherwise pairs are found in tiles of blocks of
    members, each once and with all of its sums (see tiles.sharing_pairs), so that the pairs themselves are not shuffled.
    """
    more = [F.col(value).cast("double").alias("v")] if value else []
    rows = rows.select(F.col(member).alias("m"), F.col(group).alias("g"), *more)
    if least <= 1:
        return met(rows, ["g"], "m", ("v",) if value else (), block).groupBy("left", "right").agg(*_sums(value))
    return sharing_pairs(rows, least, block=None if block == BLOCK else block).drop("left_size", "right_size")
