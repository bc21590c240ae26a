"""Writers and formatters of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _json(column: str) -> Column:
    """JSON of one scalar."""
    whole = F.to_json(F.array(F.col(column)))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def json_document(parts: dict[str, DataFrame], order: dict[str, list[Column]] | None = None, name: str = "value") -> DataFrame:
    """One JSON object with a field per part, in their order: a part whose only column is `total` is its value, another one-column part a list, and
    others a list of lists. A list is in the order of the part's rows or, where `order` names columns for it, of these; columns
    whose name begins with _ only serve for that. Parts are reports (counts, top lists); each becomes one value."""
    fields = None
    for place, (field, df) in enumerate(parts.items()):
        by = (order or {}).get(field, [F.monotonically_increasing_id()])
        shown = [_json(c) for c in df.columns if not c.startswith("_")]
        if df.columns == ["total"]:
            one = df.select(shown[0].alias("j"))
        else:
            row = shown[0] if len(shown) == 1 else F.concat(F.lit("["), F.concat_ws(", ", *shown), F.lit("]"))
            rows = df.select(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(by)), row.alias("j")).alias("r"))
            one = rows.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r.j), ", "), F.lit("]")).alias("j"))
        one = one.select(F.lit(place).alias("place"), F.lit(field).alias("f"), "j")
        fields = one if fields is None else fields.unionByName(one)
    if fields is None:
        raise ValueError("no parts")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "f", "j"))), lambda x: F.concat(F.lit('"'), x.f, F.lit('": '), x.j)), ", ")
    return fields.agg(F.concat(F.lit("{"), body, F.lit("}")).alias(name))


def write_text(df: DataFrame, path: str) -> None:
    """Lines of a report: its column `line`, or its only one. A report with numbers, `no`, is written in their order as one file."""
    if "no" in df.columns:
        df = df.repartition(1).sortWithinPartitions("no")
    df.select("line" if "line" in df.columns else df.columns[0]).write.mode("overwrite").text(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; ids need no quotes."""
    df.write.mode("overwrite").option("header", True).option("quote", "").csv(path)


def write_profiles(businesses: DataFrame, users: DataFrame, path: str) -> None:
    """A profile model as two Parquet tables: businesses (business_id, word, ..) and users (user_id, word, ..); readers.read_profiles reads them back."""
    businesses.write.mode("overwrite").parquet(f"{path}/businesses")
    users.write.mode("overwrite").parquet(f"{path}/users")


def itemset_lines(itemsets: DataFrame) -> DataFrame:
    """(size, line): the itemsets of a size on one line, ordered as text; single items as ('x')."""
    shown = F.concat(F.lit("("), F.array_join(F.transform("itemset", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit(")"))
    return itemsets.groupBy("size").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("itemset", shown.alias("s")))), lambda x: x.s), ",").alias("line"))


def itemset_report(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """The text report of candidates and frequent itemsets: (no, line), no from 1. Each block has its heading, then a line per size, with blank lines between
    sizes and between the blocks. The rows are as few as the sizes."""
    rows = None
    for block, (title, sets) in enumerate((("Candidates:", candidates), ("Frequent Itemsets:", frequent))):
        lines = itemset_lines(sets).withColumn("first", F.col("size") == F.min("size").over(Window.partitionBy(F.lit(0))))
        # A size's line and the blank one before it, which the first size has not.
        lines = lines.select("size", F.explode(F.when(F.col("first"), F.array("line")).otherwise(F.array(F.lit(""), F.col("line")))).alias("line"))
        lines = lines.select("size", F.when(F.col("line") == "", 0).otherwise(1).alias("part"), "line")
        head = sets.sparkSession.createDataFrame([*([(-1, 0, "")] if block else []), (0, 0, title)], "size int, part int, line string")
        lines = head.unionByName(lines.withColumn("size", F.col("size").cast("int"))).withColumn("block", F.lit(block))
        rows = lines if rows is None else rows.unionByName(lines)
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("block", "size", "part"))
    return rows.select(number.alias("no"), "line")


def betweenness_lines(values: DataFrame) -> DataFrame:
    """('u', 'v'), value - by value descending, then both ends: (line)."""
    line = F.concat(F.lit("('"), F.col("src"), F.lit("', '"), F.col("dst"), F.lit("'), "), F.col("value").cast("string"))
    return values.orderBy(F.desc("value"), "src", "dst").select(line.alias("line"))


def community_lines(listing: DataFrame) -> DataFrame:
    """Quoted ids joined by commas, communities by size and members: (line)."""
    line = F.array_join(F.transform("members", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")
    return listing.orderBy("size", "members").select(line.alias("line"))
