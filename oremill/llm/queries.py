"""The queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oremill.functions.ids import valid_id, valid_pairs
from oremill.llm import bpe, components, cooccur, leaks, simjoin, terms, topn
from oremill.llm import sentences as sentence


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms in too few or too many reviews."""
    return terms.term_marks(_table(spark, folder, "review")).where("mark is not null").select("term", "mark")


def p1_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every term with its occurrences, reviews and mark."""
    return terms.term_marks(_table(spark, folder, "review"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Businesses with at least 5 common users, three times as many as by chance."""
    return cooccur.item_pairs(valid_pairs(_table(spark, folder, "review")), least=5, lift=3).select("b1", "b2")


def p3_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of businesses with at least 5 common users, with counts and lift."""
    pairs = cooccur.item_pairs(valid_pairs(_table(spark, folder, "review")), least=5)
    return pairs.withColumn("lift", F.round("lift", 6))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Businesses of 3 or more users whose user sets have a Jaccard similarity of 0.5 or more."""
    return simjoin.similar_sets(valid_pairs(_table(spark, folder, "review"))).select("b1", "b2")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The three most distinctive terms of every business with 5 or more reviews."""
    best = terms.distinctive_terms(_table(spark, folder, "review"), _table(spark, folder, "stopwords"))
    return best.select(F.col("grp").alias("business_id"), "term")


def p5_enriched(spark: SparkSession, folder: str) -> DataFrame:
    """The three most enriched terms of every business with 5 or more reviews, by hypergeometric probability."""
    best = terms.enriched_terms(_table(spark, folder, "review"), _table(spark, folder, "stopwords"))
    return best.select(F.col("grp").alias("business_id"), "term", "n", "score", "place")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar b2 of every b1."""
    model = _table(spark, folder, "item_model").select(valid_id("b1").alias("b1"), valid_id("b2").alias("b2"), "sim")
    return topn.top_items(model, "b1", "b2", "sim", 5).select(F.col("grp").alias("b1"), F.col("item").alias("b2"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every user and business of the state extract with its group."""
    return components.linked_groups(valid_pairs(_table(spark, folder, "sample_data")), "user_id", "business_id")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids in byte_bpe_50k."""
    return bpe.encoded(_table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that carry passages of evaluation items."""
    return leaks.leaked(_table(spark, folder, "documents"), _table(spark, folder, "eval_items"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every sentence of every document."""
    return sentence.sentences(_table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_terms, p3_found, p3_pairs, p4_found, p5_found, p5_enriched, p6_found, p7_found, p8_ids, p9_found, p10_found)}
