"""Groups of records that are linked directly or through others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from oremill.functions.ids import numbered
from oremill.functions.shared import discard, written


def _pointers(edges: DataFrame) -> DataFrame:
    """(v, p): p is the least of v and its neighbours, as far as it is smaller than v. edges has (a, b) with a < b, each once."""
    return edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p"))


def _jumped(pointers: DataFrame) -> DataFrame:
    """(v, p, open): pointers three steps on, and whether there may be further to go."""
    on = lambda a, b: pointers.select(F.col("v").alias(a), F.col("p").alias(b))
    far = pointers.join(on("p", "q"), "p", "left").select("v", "p", "q").join(on("q", "r"), "q", "left")
    return far.select("v", F.coalesce("r", "q", "p").alias("p"), F.col("r").isNotNull().alias("open"))


def _counted(df: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """The table written, and its number of rows, or of those that are `open`, as counted by the write."""
    seen = Observation()
    table = written(df.observe(seen, F.count_if(F.col("open") if "open" in df.columns else F.lit(True)).alias("n")), tag)
    return table, seen.get["n"]


def linked_groups(pairs: DataFrame, left: str, right: str, most_rounds: int = 100) -> DataFrame:
    """(member_id, group_id) of every id in pairs: the group's smallest id, over all direct and indirect links.

    Rows in which either id is null are left out, repeated rows and loops change nothing; a loop's id is a group of its own. An
    empty table gives no rows.

    Minimum labels with pointer jumping: in each round every vertex takes the least label among its neighbours, pointers are doubled
    until all reach the end of their chain, and the edges are redrawn between the labels reached. A vertex that is not the least
    around it is gone after that. A round may only take the ends of a star one by one (a centre with the largest id loses itself first), but of the
    vertices that are left after it every second one is gone after the next, so they at least halve with every two rounds; it ends when no
    edge joins two labels, that is when no label changes any more. Each round's tables are written to the shared folder. A vertex with very many links is no hot
    spot: minima are combined before the shuffle, and the joins have one row a vertex on the side of the pointers.
    """
    links = pairs.select(F.col(left).alias("l"), F.col(right).alias("r")).where("l is not null and r is not null").distinct()
    links = written(links, "links")
    ids = numbered(links.select(F.explode(F.array("l", "r")).alias("member_id")), "member_id", "number")
    ends = links.join(ids.select(F.col("member_id").alias("l"), F.col("number").alias("x")), "l").join(ids.select(F.col("member_id").alias("r"), F.col("number").alias("y")), "r")
    edges, more = _counted(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct(), "edges")
    labels = ids.select("number", F.col("number").alias("label"))
    labels_table = None
    for _ in range(most_rounds):
        if not more:
            break
        pointers, moved = _counted(_jumped(_pointers(edges)), "pointers")
        while moved:
            before = pointers
            pointers, moved = _counted(_jumped(pointers.select("v", "p")), "pointers")
            discard(before)
        move = pointers.select(F.col("v").alias("label"), F.col("p").alias("to"))
        new_labels = written(labels.join(move, "label", "left").select("number", F.coalesce("to", "label").alias("label")), "labels")
        redrawn = edges.join(pointers.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a", "left").join(pointers.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b", "left")
        redrawn = redrawn.select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y")).where("x <> y")
        new_edges, more = _counted(redrawn.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        for old in (edges, pointers, labels_table):
            discard(old)
        edges, labels, labels_table = new_edges, new_labels, new_labels
    else:
        raise RuntimeError("no end of the links was reached")
    discard(links)
    discard(edges)
    first = ids.select(F.col("number").alias("label"), F.col("member_id").alias("group_id"))
    return labels.join(ids, "number").join(first, "label").select("member_id", "group_id")
