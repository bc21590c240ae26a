"""Ids: what counts as one, order-preserving numbers for them, and the keys that hold too many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oremill.functions.shared import written

#: White space that may surround an id (fixed value).
OUTER = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*"
#: Form of a valid id (fixed value).
VALID = r"[A-Za-z0-9_-]{22}"


def valid_id(column: str | Column) -> Column:
    """The id without outer white space, or null if it is no valid id (null, blank, a placeholder, another form)."""
    # One anchored match: ids are most of what these tables hold, so this runs for every row.
    found = F.regexp_extract(F.col(column) if isinstance(column, str) else column, rf"\A{OUTER}({VALID}){OUTER}\z", 1)
    return F.nullif(found, F.lit(""))


def valid_pairs(rows: DataFrame, one: str = "user_id", two: str = "business_id") -> DataFrame:
    """(one, two) of the rows in which both are valid ids; repeated pairs are kept. An empty table gives none."""
    both = rows.select(valid_id(one).alias(one), valid_id(two).alias(two))
    return both.where(F.col(one).isNotNull() & F.col(two).isNotNull())


def numbered(keys: DataFrame, key: str, number: str) -> DataFrame:
    """Distinct keys with int64 numbers that keep their order. They are not dense. Written, so that a rerun task can't change them."""
    ordered = keys.select(key).distinct().orderBy(key)
    return written(ordered.withColumn(number, F.monotonically_increasing_id()), "numbers")


def hot_keys(df: DataFrame, key: str, share: int = 100_000, least: int = 10_000) -> DataFrame:
    """Keys that hold more than `least` rows, with the number of pieces of that size they should be split into: (key, pieces). Null keys are ignored.

    There are at most `share` of them, so that the result may be broadcast at any size of df: above share * least rows, 10^9 as it stands, the bound is
    1/share of the rows.
    """
    total = df.count()
    bound = max(least, total // share)
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > bound)
    found = [(r[0], -(-r[1] // bound)) for r in counts.collect()]
    kind = df.schema[key].dataType.simpleString()
    return df.sparkSession.createDataFrame(found, f"{key} {kind}, pieces int")
