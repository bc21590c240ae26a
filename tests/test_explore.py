from pyspark.sql import functions as F

from oremill.operators import explore

REVIEWS = [
    ("u1", "b1", 5.0, "2014-01-01", "Great food! great ... Wine"),
    ("u1", "b2", 3.0, "2015-02-01", "The food, the (food)"),
    ("u2", "b1", None, None, None),
    (None, "b1", 1.0, "x2014", ""),
]
SCHEMA = "user_id string, business_id string, stars double, date string, text string"


def test_counts(spark):
    df = spark.createDataFrame(REVIEWS, SCHEMA)
    assert explore.review_total(df).first().total == 4
    assert explore.reviews_in_year(df, 2014).first().total == 2
    assert explore.distinct_users(df).first().total == 2
    assert explore.review_total(df.limit(0)).first().total == 0
    assert [tuple(r) for r in explore.top_users(df, 1).collect()] == [("u1", 2)]


def test_top_users_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "user_id string")
    assert [r.user_id for r in explore.top_users(df, 2).collect()] == ["a", "b"]


def test_top_words_keeps_empty_words_only_on_request(spark):
    df, stop = spark.createDataFrame(REVIEWS, SCHEMA), spark.createDataFrame([("the",)], "word string")
    assert [tuple(r) for r in explore.top_words(df, stop, 3).collect()] == [("food", 3), ("great", 2), ("", 1)]
    assert "" not in {r.word for r in explore.top_words(df, stop, 9, keep_empty=False).collect()}


def test_category_average_weights_by_review(spark):
    reviews = spark.createDataFrame(REVIEWS, SCHEMA)
    places = spark.createDataFrame([("b1", "Bars, Food", 1), ("b2", " Food ,", 2), ("b3", None, 3), (None, "X", 4)], "business_id string, categories string, s int")
    got = [tuple(r) for r in explore.category_average(reviews, places).collect()]
    assert got == [("Bars", 3.0), ("Food", 3.0)]
    assert len(explore.category_average(reviews, places, 1).collect()) == 1


def test_partitions(spark):
    df = spark.createDataFrame([("ab",), ("ba",), ("c",), (None,)], "k string")
    got = dict(tuple(r) for r in explore.partition_profile(df, 4, "k").collect())
    assert got == {0: 1, 1: 0, 2: 0, 3: 3}  # 97 + 98 = 195 and 99 are 3 mod 4
    assert sum(r.rows for r in explore.partition_profile(df.repartition(3)).collect()) == 4
    assert spark.range(1).select(explore.code_sum(F.lit("abc"))).first()[0] == 294


def test_businesses_and_state(spark):
    df = spark.createDataFrame(REVIEWS, SCHEMA)
    assert [tuple(r) for r in explore.busy_businesses(df, 2).collect()] == [("b1", 3)]
    assert explore.busy_businesses(df, 3).collect() == []
    places = spark.createDataFrame([("b1", "NV"), ("b2", "AZ"), ("b1", "NV")], "business_id string, state string")
    assert explore.state_pairs(df, places).count() == 3
