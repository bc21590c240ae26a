"""Exploratory aggregation, joins and partition inspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oremill.functions.text import clean_word, single_space_tokens


def review_total(reviews: DataFrame) -> DataFrame:
    """(total): number of rows; 0 for an empty table."""
    return reviews.agg(F.count("*").alias("total"))


def reviews_in_year(reviews: DataFrame, year: int | str) -> DataFrame:
    """(total): rows whose date text contains the year; a null date does not."""
    return reviews.agg(F.count_if(F.col("date").contains(str(year))).alias("total"))


def distinct_users(reviews: DataFrame) -> DataFrame:
    """(total): distinct non-null users."""
    return reviews.agg(F.count_distinct("user_id").alias("total"))


def top_users(reviews: DataFrame, m: int) -> DataFrame:
    """(user_id, n): the m users with most rows, ties by user_id. Null users are left out."""
    counts = reviews.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "user_id").limit(m)


def top_words(reviews: DataFrame, stopwords: DataFrame, n: int, keep_empty: bool = True) -> DataFrame:
    """(word, n): the n most frequent words, ties by word. stopwords has (word).

    A text is split at single spaces, empty tokens are dropped, and punctuation is deleted. A token of punctuation alone then is an empty
    word, which counts with keep_empty unless it is a stopword.
    """
    words = reviews.select(F.explode(single_space_tokens(F.col("text"))).alias("token")).select(clean_word(F.col("token")).alias("word"))
    if not keep_empty:
        words = words.where(F.col("word") != "")
    # Counting before the join leaves one row per word to compare with the stopwords.
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return counts.join(stopwords.select("word"), "word", "left_anti").orderBy(F.desc("n"), "word").limit(n)


def category_average(reviews: DataFrame, businesses: DataFrame, n: int | None = None, sep: str = ",") -> DataFrame:
    """(category, avg_stars): mean stars over all reviews of a category's businesses, best first, ties by category; all without n.

    Null stars do not count. A category that a business names twice counts twice. Sums are taken per business before the join, so that the join
    has one row per business and not one per review.
    """
    sums = reviews.where(F.col("stars").isNotNull()).groupBy("business_id").agg(F.sum("stars").alias("s"), F.count("*").alias("c"))
    names = F.filter(F.transform(F.split("categories", sep, -1), lambda x: F.trim(x)), lambda x: x != "")
    categories = businesses.where(F.col("categories").isNotNull()).select("business_id", F.explode(names).alias("category"))
    means = categories.join(sums, "business_id").groupBy("category").agg((F.sum("s") / F.sum("c")).alias("avg_stars"))
    means = means.select("category", F.round("avg_stars", 6).alias("avg_stars")).orderBy(F.desc("avg_stars"), "category")
    return means.limit(n) if n is not None else means


def code_sum(key: Column) -> Column:
    """Sum of the codes of a key's characters; null for null."""
    return F.aggregate(F.transform(F.filter(F.split(key, ""), lambda c: c != ""), F.ascii), F.lit(0), lambda a, x: a + x)


def partition_profile(df: DataFrame, n: int | None = None, key: str | None = None) -> DataFrame:
    """(partition, rows) of every partition, empty ones too. With n and key, rows go to partition code_sum(key) mod n; null keys to 0."""
    if n is not None:
        df = df.repartitionById(n, F.coalesce(code_sum(F.col(key)), F.lit(0)))
    number = n if n is not None else df.rdd.getNumPartitions()
    counts = df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("rows"))
    every = df.sparkSession.range(number).select(F.col("id").cast("int").alias("partition"))
    return every.join(counts, "partition", "left").select("partition", F.coalesce("rows", F.lit(0)).alias("rows"))


def busy_businesses(reviews: DataFrame, n: int) -> DataFrame:
    """(business_id, n): businesses with strictly more than n rows."""
    counts = reviews.where(F.col("business_id").isNotNull()).groupBy("business_id").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > n)


def state_pairs(reviews: DataFrame, businesses: DataFrame, state: str = "NV") -> DataFrame:
    """(user_id, business_id) of the reviews of businesses in a state; duplicates are kept."""
    there = businesses.where(F.col("state") == state).select("business_id")
    return reviews.select("user_id", "business_id").join(there, "business_id", "left_semi").select("user_id", "business_id")
