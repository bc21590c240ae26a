"""Content-based recommendation: TF-IDF profiles of businesses and users, and their cosine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oremill.functions.ids import hot_keys
from oremill.functions.shared import written
from oremill.functions.text import PUNCTUATION_AND_DIGITS, clean_word, whitespace_tokens
from oremill.operators.similarity import dense_index


def document_words(reviews: DataFrame, stopwords: DataFrame, hot: int = 10_000) -> DataFrame:
    """(business_id, word, n): counts of the words of a business's reviews, each (business, user, text) once. stopwords has (word).

    The texts move to their business once and are counted there. A business of over `hot` rows is spread by user and text, and only its counts are added up
    after.
    """
    texts = reviews.select("business_id", "user_id", "text").where("business_id is not null and text is not null")
    spread = F.pmod(F.xxhash64("user_id", "text"), F.col("pieces")).cast("int")
    texts = texts.join(F.broadcast(hot_keys(texts, "business_id", least=hot)), "business_id", "left").select("business_id", F.coalesce(spread, F.lit(-1)).alias("part"), "user_id", "text")
    texts = texts.repartition("business_id", "part").distinct()
    words = texts.select("business_id", "part", F.explode(whitespace_tokens(F.col("text"))).alias("token"))
    words = words.select("business_id", "part", clean_word(F.col("token"), PUNCTUATION_AND_DIGITS).alias("word")).where(F.col("word") != "")
    counts = words.groupBy("business_id", "part", "word").agg(F.count("*").alias("n")).join(stopwords.select("word"), "word", "left_anti")
    counts = written(counts.select("business_id", "part", "word", "n"), "words")
    many = counts.where("part >= 0").groupBy("business_id", "word").agg(F.sum("n").alias("n"))
    return counts.where("part < 0").select("business_id", "word", "n").unionByName(many)


def document_frequency(words: DataFrame) -> DataFrame:
    """(word, businesses): number of businesses that hold the word."""
    return words.groupBy("word").agg(F.count("*").alias("businesses"))


def tfidf_profile(reviews: DataFrame, stopwords: DataFrame, k: int = 200, most_heavy: int = 65_536) -> DataFrame:
    """(business_id, word, score, rank): the k words with the highest (count / highest count) * log2(N / n_word), ties by word; N counts the
    businesses with a review. A business without words has no rows."""
    words = document_words(reviews, stopwords)
    total = reviews.where("business_id is not null").agg(F.count_distinct("business_id")).first()[0]
    top = words.groupBy("business_id").agg(F.max("n").alias("top"))
    frequencies = written(document_frequency(words), "frequencies")
    entries = frequencies.agg(F.sum("businesses")).first()[0] or 0
    # Fewer than `most_heavy` words have over 1 / most_heavy of the entries each: they are broadcast, and only the other words' rows move to their frequency.
    often = (F.col("businesses") * most_heavy > entries) & (F.length("word") <= 200)
    heavy = F.broadcast(frequencies.where(often))
    found = words.join(heavy, "word").unionByName(words.join(heavy.select("word"), "word", "left_anti").join(frequencies.where(~often), "word"))
    scored = found.join(top, "business_id")
    score = F.round(F.col("n") / F.col("top") * F.log2(F.lit(float(max(total, 1))) / F.col("businesses")), 6)
    best = Window.partitionBy("business_id").orderBy(F.desc("score"), "word")
    ranked = scored.select("business_id", "word", score.alias("score")).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k)


def _word_numbers(profile: DataFrame) -> DataFrame:
    """(word, w): the profiles' words numbered in their order."""
    return dense_index(profile, "word", "w")


def _lists(profile: DataFrame, key: str, numbers: DataFrame) -> DataFrame:
    """(key, ws): a profile's words as an array of their numbers, which is a fraction of what the words weigh as rows."""
    return profile.select(key, "word").join(numbers, "word").groupBy(key).agg(F.collect_list("w").alias("ws"))


def user_profile(reviews: DataFrame, business_profile: DataFrame, k: int = 200, hot: int = 10_000) -> DataFrame:
    """(user_id, word, rank): words of all businesses that the user reviewed, by the number of those businesses, ties by word.

    The businesses' profiles move to the users as arrays of word numbers and are taken apart there, so that neither the counts nor the ranks move again.
    Users with over `hot` businesses are counted before they move.
    """
    visited = written(reviews.select("user_id", "business_id").where("user_id is not null and business_id is not null").distinct(), "visited")
    profile = business_profile.select("business_id", "word")
    numbers = written(_word_numbers(profile), "words")
    lists = _lists(profile, "business_id", numbers)
    often = F.broadcast(hot_keys(visited, "user_id", least=hot).select("user_id"))
    best = Window.partitionBy("user_id").orderBy(F.desc("n"), "w")

    def ranked(held: DataFrame) -> DataFrame:
        counts = held.select("user_id", F.explode("ws").alias("w")).groupBy("user_id", "w").agg(F.count("*").alias("n"))
        return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    few = ranked(visited.join(often, "user_id", "left_anti").join(lists, "business_id").select("user_id", "ws").repartition("user_id"))
    many = ranked(visited.join(often, "user_id", "left_semi").join(lists, "business_id"))
    return few.unionByName(many).join(numbers, "w").select("user_id", "word", "rank")


def content_scores(pairs: DataFrame, users: DataFrame, businesses: DataFrame, threshold: float = 0.01) -> DataFrame:
    """(user_id, business_id, sim): cosine of both sides' word sets, where at least the threshold, which must be above 0. Repeated pairs
    stay repeated; a pair of which one side has no profile drops out. Profiles are (key, word), each word once."""
    if threshold <= 0:
        raise ValueError("threshold must be above 0")
    users, businesses = written(users.select("user_id", "word"), "users"), written(businesses.select("business_id", "word"), "businesses")
    # Words that no business has are in nothing common: they count in the user's length only.
    numbers = written(_word_numbers(businesses), "words")
    own = users.groupBy("user_id").agg(F.count("*").alias("nu")).join(_lists(users, "user_id", numbers).withColumnRenamed("ws", "wu"), "user_id")
    its = _lists(businesses, "business_id", numbers).withColumnRenamed("ws", "wb")
    wanted = pairs.groupBy("user_id", "business_id").agg(F.count("*").alias("times"))
    met = wanted.join(own, "user_id").join(its, "business_id").withColumn("n", F.size(F.array_intersect("wu", "wb")))
    scored = met.withColumn("sim", F.col("n") / (F.sqrt("nu") * F.sqrt(F.size("wb"))))
    kept = scored.where(F.col("sim") >= threshold).select("user_id", "business_id", F.round("sim", 6).alias("sim"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_"))
    return kept.drop("_")
