"""Readers of review-style files. All schemas are explicit; a malformed JSON line fails the job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oremill.functions.ids import valid_id, valid_pairs

_S, _D = T.StringType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


REVIEW = _struct(user_id=_S, business_id=_S, stars=_D, date=_S, text=_S)
BUSINESS = _struct(business_id=_S, categories=_S, state=_S)
PAIR = _struct(user_id=_S, business_id=_S)
RATING = _struct(business_id=_S, user_id=_S, stars=_D)
ITEM_MODEL = _struct(b1=_S, b2=_S, sim=_D)
USER_MODEL = _struct(u1=_S, u2=_S, sim=_D)
PROFILES = _struct(Business_profile=T.MapType(_S, T.ArrayType(_S)), User_Profile=T.MapType(_S, T.ArrayType(_S)))


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with the schema's fields; others are not read. A line that is no JSON object fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_pairs_csv(spark: SparkSession, path: str, schema: T.StructType = PAIR) -> DataFrame:
    """Headered CSV of text columns. Every line equal to the header is dropped, not only the first."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    header = F.lit(True)
    for name in schema.names:
        header = header & F.col(name).eqNullSafe(F.lit(name))
    return rows.where(~header)


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """One word per line, in lower case and trimmed: (word)."""
    return clean_stopwords(spark.read.text(path))


def clean_stopwords(words: DataFrame) -> DataFrame:
    """Distinct words of the first column, in lower case and trimmed; an empty line is the empty word, null is none: (word)."""
    word = F.lower(F.trim(F.col(words.columns[0])))
    return words.select(word.alias("word")).where(F.col("word").isNotNull()).distinct()


def read_profiles(spark: SparkSession, path: str, form: str = "json") -> tuple[DataFrame, DataFrame]:
    """A profile model: (business_id, word) and (user_id, word). form `json` is one JSON object with a list of words for each id, `parquet` the
    two tables of sinks.write_profiles."""
    if form == "parquet":
        return tuple(spark.read.parquet(f"{path}/{side}").select(key, "word") for side, key in (("businesses", "business_id"), ("users", "user_id")))
    if form != "json":
        raise ValueError("form is json or parquet")
    model = read_json(spark, path, PROFILES)

    def side(column: str, key: str) -> DataFrame:
        return model.select(F.explode(column).alias(key, "words")).select(key, F.explode("words").alias("word"))

    return side("Business_profile", "business_id"), side("User_Profile", "user_id")


# Tables as they come in the test data ---------------------------------------------------------------------------------


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def reviews(spark: SparkSession, folder: str, once: bool = True) -> DataFrame:
    """The review table in the reviews' form: ids trimmed, null where there is no valid one, each review once. A query leaves out the
    reviews that lack an id it needs. Without `once` a review comes as often as it was delivered, for queries to which it makes no difference."""
    rows = table(spark, folder, "review")
    rows = rows.select("review_id", valid_id("user_id").alias("user_id"), valid_id("business_id").alias("business_id"), "stars", "date", "text")
    rows = rows.where("review_id is not null")
    return rows.dropDuplicates(["review_id"]) if once else rows


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, business_id, stars): the highest rating from 1 to 5 of each pair; null, NaN and other stars are no ratings."""
    rows = table(spark, folder, "review").select(valid_id("user_id").alias("user_id"), valid_id("business_id").alias("business_id"), "stars")
    rows = rows.where("user_id is not null and business_id is not null and stars between 1 and 5 and not isnan(stars)")
    return rows.groupBy("user_id", "business_id").agg(F.max("stars").alias("stars"))


def businesses(spark: SparkSession, folder: str) -> DataFrame:
    """(business_id, categories, state), each valid business once; state trimmed and in upper case."""
    rows = table(spark, folder, "business").select(valid_id("business_id").alias("business_id"), "categories", F.upper(F.trim("state")).alias("state"))
    return rows.where("business_id is not null").groupBy("business_id").agg(F.max("categories").alias("categories"), F.max("state").alias("state"))


def state_extract(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, business_id) of the state extract, rows with two valid ids; repeated pairs are kept."""
    return valid_pairs(table(spark, folder, "sample_data"))


def item_model(spark: SparkSession, folder: str) -> DataFrame:
    """(b1, b2, sim) of the pair model, each pair once with its highest sim; null and NaN are none."""
    rows = table(spark, folder, "item_model").select(valid_id("b1").alias("b1"), valid_id("b2").alias("b2"), "sim")
    rows = rows.where("b1 is not null and b2 is not null and b1 <> b2 and sim is not null and not isnan(sim)")
    return rows.groupBy(F.least("b1", "b2").alias("b1"), F.greatest("b1", "b2").alias("b2")).agg(F.max("sim").alias("sim"))


def event_baskets(spark: SparkSession, folder: str) -> DataFrame:
    """(basket, item): the event types of a user's day; the basket's number has the day and the user."""
    rows = table(spark, folder, "events").where("user_id is not null and ts is not null and event_type is not null")
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return rows.select((F.col("user_id") * 100_000 + day).alias("basket"), F.col("event_type").alias("item"))
