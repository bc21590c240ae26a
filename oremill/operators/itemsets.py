"""Frequent itemsets by the two-pass SON method."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oremill.functions.shared import discard, written
from oremill.operators.pairs import met
from oremill.operators.similarity import dense_index


def baskets(df: DataFrame, key: str, item: str, min_size: int | None = None) -> DataFrame:
    """(basket, item), distinct, without nulls; with min_size only baskets of strictly more distinct items. The long form has no row
    that grows with a basket."""
    rows = df.select(F.col(key).alias("basket"), F.col(item).alias("item")).where("basket is not null and item is not null").distinct()
    if min_size is None:
        return rows
    kept = rows.groupBy("basket").agg(F.count("*").alias("size")).where(F.col("size") > min_size)
    return rows.join(kept.select("basket"), "basket", "left_semi")


def basket_lists(rows: DataFrame) -> DataFrame:
    """(basket, size, items): the sorted items of each basket, joined by commas."""
    lists = rows.groupBy("basket").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return lists.select("basket", F.size("items").cast("bigint").alias("size"), F.array_join("items", ",").alias("items"))


def _levels(rows: DataFrame, scope: list[str], least: DataFrame | int, most_size: int | None) -> list[DataFrame]:
    """Level-wise A-priori: for each size (scope.., itemset, support) of the sets that reach `least` within each scope.

    Frequent items are numbered in their order, and sets are kept as numbers with the baskets that hold them: all but the last as `prefix`, and the last. Two sets
    of a basket with equal prefixes make a candidate of the next size; a basket with very many of them is paired in blocks (see pairs.met).
    """

    def enough(counts: DataFrame) -> DataFrame:
        if isinstance(least, int):
            return counts.where(F.col("support") >= least)
        return counts.join(F.broadcast(least), scope).where(F.col("support") >= F.col("least")).drop("least")

    singles = written(enough(rows.groupBy(*scope, "item").agg(F.count("*").alias("support"))), "itemsets")
    if singles.isEmpty():
        return []
    numbers = written(dense_index(singles, "item", "x").withColumn("x", F.col("x").cast("int")), "items")
    found = [singles.select(*scope, F.array("item").alias("itemset"), "support")]
    kept = rows.join(singles.select(*scope, "item"), [*scope, "item"], "left_semi").join(numbers, "item")
    held = written(kept.select(*scope, "basket", F.array().cast("array<int>").alias("prefix"), "x"), "held")

    def named(counts: DataFrame) -> DataFrame:
        each = counts.select(*scope, "support", F.array_append("prefix", F.col("x")).alias("set")).select("*", F.explode("set").alias("x")).join(numbers, "x")
        return each.groupBy(*scope, "set", "support").agg(F.array_sort(F.collect_list("item")).alias("itemset")).select(*scope, "itemset", "support")

    while len(found) != most_size:
        grown = met(held, [*scope, "basket", "prefix"], "x").select(*scope, "basket", F.array_append("prefix", F.col("left")).alias("prefix"), F.col("right").alias("x"))
        counts = written(enough(grown.groupBy(*scope, "prefix", "x").agg(F.count("*").alias("support"))), "itemsets")
        if counts.isEmpty():
            break
        found.append(named(counts))
        before = held
        held = written(grown.join(counts.select(*scope, "prefix", "x"), [*scope, "prefix", "x"], "left_semi"), "held")
        discard(before)
    return found


def _union(levels: list[DataFrame], empty: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, levels) if levels else empty


def son_candidates(rows: DataFrame, support: int, partitions: int, part: Column) -> DataFrame:
    """(itemset, size): itemsets that reach the scaled support ceil(support * n_p / n) in at least one part; part gives each basket's.

    `part` must depend on the basket alone; there are `partitions` of them. Support must be at least 1.
    """
    if support < 1:
        raise ValueError("support must be at least 1")
    rows = written(rows.withColumn("pid", part.cast("int")).withColumn("item", F.col("item").cast("string")), "baskets")
    sizes = rows.groupBy("pid").agg(F.count_distinct("basket").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    least = sizes.select("pid", F.ceil(F.lit(support) * F.col("n") / F.lit(max(total, 1))).alias("least"))
    levels = _levels(rows, ["pid"], written(least, "least"), None)
    empty = rows.select(F.array("item").alias("itemset")).limit(0)
    found = _union([x.select("itemset") for x in levels], empty).distinct()
    return found.select("itemset", F.size("itemset").alias("size"))


def frequent_itemsets(rows: DataFrame, support: int, candidates: DataFrame | None = None, most_size: int | None = None) -> DataFrame:
    """(itemset, size, support): itemsets in at least `support` baskets, items sorted. With candidates, those are counted (second pass);
    else they are found level by level. Both give the same sets if the candidates come from son_candidates with the same support."""
    if support < 1:
        raise ValueError("support must be at least 1")
    rows = rows.withColumn("item", F.col("item").cast("string"))
    if candidates is None:
        levels = _levels(written(rows, "baskets"), [], support, most_size)
        empty = rows.select(F.array("item").alias("itemset"), F.lit(0).cast("bigint").alias("support")).limit(0)
        found = _union(levels, empty)
        return found.select("itemset", F.size("itemset").alias("size"), "support")
    members = candidates.select("itemset", F.size("itemset").alias("size"), F.explode("itemset").alias("item"))
    held = rows.join(members, "item").groupBy("basket", "itemset", "size").agg(F.count("*").alias("n")).where("n = size")
    return held.groupBy("itemset", "size").agg(F.count("*").alias("support")).where(F.col("support") >= support)

