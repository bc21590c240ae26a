from conftest import make_id
from pyspark.sql import functions as F

from oremill.functions.ids import hot_keys, numbered, valid_id, valid_pairs


def test_valid_id_trims_and_rejects(spark):
    good = make_id("a")
    rows = [(f" {good}\t",), (f" {good}\n",), (good,), (good + "x",), ("N/A",), ("",), (None,), (good[:-1] + "ü",), (good + "\nx",)]
    got = [r[0] for r in spark.createDataFrame(rows, "id string").select(valid_id("id")).collect()]
    assert got == [good, good, good, None, None, None, None, None, None]


def test_valid_pairs_needs_both_and_ignores_other_columns(spark):
    a, b = make_id("a"), make_id("b")
    df = spark.createDataFrame([(a, b, 1), (a, None, 2), ("?", b, 3)], "user_id string, business_id string, count int")
    assert valid_pairs(df).collect() == [(a, b)]
    assert valid_pairs(df.limit(0)).collect() == []


def test_numbers_keep_order_and_are_unique(spark):
    keys = spark.createDataFrame([(f"{i * 7919 % 1000:04d}",) for i in range(1000)] * 2, "k string").repartition(7)
    rows = numbered(keys, "k", "n").orderBy("n").collect()
    assert [r.k for r in rows] == sorted({r.k for r in rows}) and len(rows) == 1000


def test_hot_keys_are_few(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, "hot").when(F.col("id") > 990, None).otherwise(F.col("id").cast("string")).alias("k"))
    assert [tuple(r) for r in hot_keys(df, "k", share=10, least=10).collect()] == [("hot", 4)]
    assert hot_keys(df.limit(0), "k").collect() == []
