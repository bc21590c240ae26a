import itertools
import random

import pytest
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import functions as F

from oremill.operators import itemsets
from oremill.sources import sinks


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(3)
    data = [(b, x) for b in range(60) for x in draw.choices("abcdefg", k=draw.randint(1, 6))]
    return itemsets.baskets(spark.createDataFrame([*data, *data[:40], (None, "a"), (1, None)], "user long, item string"), "user", "item")


def brute(rows, support):
    by: dict = {}
    for r in rows.collect():
        by.setdefault(r.basket, set()).add(r.item)
    counts: dict = {}
    for held in by.values():
        for k in range(1, len(held) + 1):
            for s in itertools.combinations(sorted(held), k):
                counts[s] = counts.get(s, 0) + 1
    return {s: n for s, n in counts.items() if n >= support}


def found(df):
    return {tuple(r.itemset): r.support for r in df.collect()}


def test_levels_match_brute_force_and_are_closed_downward(rows):
    got = found(itemsets.frequent_itemsets(rows, 8))
    assert got == brute(rows, 8) and max(map(len, got)) >= 2
    assert all(s[:i] + s[i + 1 :] in got for s in got if len(s) > 1 for i in range(len(s)))


@pytest.mark.parametrize("parts", [1, 3, 5])
def test_son_is_independent_of_the_parts(rows, parts):
    candidates = itemsets.son_candidates(rows, 8, parts, F.pmod("basket", F.lit(parts)))
    got = found(itemsets.frequent_itemsets(rows, 8, candidates))
    assert got == brute(rows, 8)
    assert set(got) <= {tuple(r.itemset) for r in candidates.collect()}


def test_fp_growth_agrees(rows):
    lists = rows.groupBy("basket").agg(F.collect_set("item").alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=(8 - 0.5) / lists.count()).fit(lists)
    assert {tuple(sorted(r["items"])): r.freq for r in model.freqItemsets.collect()} == brute(rows, 8)


def test_sizes_empty_and_bad_support(spark, rows):
    assert rows.count() == rows.distinct().count()
    small = itemsets.baskets(rows.withColumnRenamed("basket", "u"), "u", "item", 3)
    assert small.groupBy("basket").count().agg(F.min("count")).first()[0] > 3
    empty = rows.limit(0)
    assert itemsets.frequent_itemsets(empty, 1).collect() == []
    assert itemsets.son_candidates(empty, 1, 2, F.pmod("basket", F.lit(2))).collect() == []
    with pytest.raises(ValueError):
        itemsets.frequent_itemsets(rows, 0)


def test_report(spark, tmp_path):
    sets = spark.createDataFrame([(["b"], 1), (["a"], 1), (["a", "b"], 2)], "itemset array<string>, size int")
    got = sinks.itemset_report(sets, sets.where("size = 1")).orderBy("no").collect()
    assert "\n".join(r.line for r in got) == "Candidates:\n('a'),('b')\n\n('a', 'b')\n\nFrequent Itemsets:\n('a'),('b')"
    assert [r.no for r in got] == list(range(1, 8))
    assert [r.line for r in sinks.itemset_report(sets.limit(0), sets.limit(0)).orderBy("no").collect()] == ["Candidates:", "", "Frequent Itemsets:"]
    sinks.write_text(sinks.itemset_report(sets, sets), str(tmp_path / "report"))
    (file,) = (tmp_path / "report").glob("part-*.txt")
    assert file.read_text().splitlines()[:2] == ["Candidates:", "('a'),('b')"]
