import math
import random
from collections import defaultdict

import pyarrow as pa
import pytest

from oremill.llm import components, topn


def test_loser_tree_merges():
    draw = random.Random(4)
    for k in (0, 1, 2, 3, 7, 20):
        lists = [sorted((draw.randint(0, 9), draw.choice("abc")) for _ in range(draw.randint(0, 6))) for _ in range(k)]
        tree, out = topn.LoserTree([list(x) for x in lists]), []
        while (head := tree.pop()) is not None:
            out.append(head)
        assert out == sorted(x for one in lists for x in one)


@pytest.mark.parametrize("fan_in", [2, 64])
def test_top_items(spark, fan_in):
    draw = random.Random(6)
    rows = [(draw.choice(["g", "g", "h", "i", None]), draw.choice([f"x{i}" for i in range(12)] + [None]), draw.choice([0.5, 0.25, -1.0, 0.0, -0.0, math.nan, None, 2.0]), "z") for _ in range(400)]
    df = spark.createDataFrame(rows, "a string, b string, s double, grp string").repartition(9)
    best: dict = defaultdict(dict)
    for g, i, s, _ in rows:
        if g is not None and i is not None and s is not None and not math.isnan(s):
            best[g][i] = max(best[g].get(i, -math.inf), s)
    want = {(g, i) for g, items in best.items() for i, _ in sorted(items.items(), key=lambda x: (-x[1], x[0]))[:3]}
    got = topn.top_items(df, "a", "b", "s", 3, fan_in=fan_in).collect()
    assert {(r.grp, r["item"]) for r in got} == want and len(got) == len(want)
    assert topn.top_items(df.limit(0), "a", "b", "s").collect() == []


def test_cut_seeks_over_batches_of_any_size():
    """Sorted rows with repeated items, cut into batches, against the plain rule."""
    draw = random.Random(8)
    rows = sorted(((g, -draw.randint(0, 4), f"x{draw.randint(0, 6)}") for g in "aabccccd" for _ in range(draw.randint(1, 30))), key=lambda r: r)
    want, seen = [], defaultdict(list)
    for g, s, i in rows:
        if len(seen[g]) < 4 and i not in seen[g]:
            seen[g].append(i)
            want.append((g, i))
    table = pa.table([[g for g, _, _ in rows], [0] * len(rows), [1] * len(rows), [float(-s) for _, s, _ in rows], [i for _, _, i in rows]], schema=topn._SCHEMA)
    for size in (1, 2, 5, 17, 1000):
        got = [p for b in topn._cut(iter(table.to_batches(max_chunksize=size)), 4) for p in zip(b.column(0).to_pylist(), b.column(4).to_pylist(), strict=True)]
        assert got == want, size


def brute_groups(pairs):
    group = {}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in pairs:
        for x in (a, b):
            group.setdefault(x, x)
        a, b = find(a), find(b)
        group[max(a, b)] = min(a, b)
    return {x: find(x) for x in group}


@pytest.mark.parametrize("shape", ["random", "chain", "star"])
def test_linked_groups(spark, shape):
    draw = random.Random(8)
    names = [f"n{i:03d}" for i in range(200)]
    draw.shuffle(names)
    if shape == "chain":
        pairs = list(zip(names[:150], names[1:151], strict=True))
    elif shape == "star":
        pairs = [(names[0], n) for n in names[1:100]] + [(n, names[150]) for n in names[151:]]
    else:
        pairs = [(draw.choice(names), draw.choice(names)) for _ in range(130)] + [("loop", "loop")]
    df = spark.createDataFrame([(*p, 1) for p in [*pairs, *pairs[:9]]] + [(None, "n000", 1), ("n001", None, 1)], "x string, y string, label int")
    got = components.linked_groups(df, "x", "y").collect()
    assert {r.member_id: r.group_id for r in got} == brute_groups(pairs) and len(got) == len(brute_groups(pairs))


def test_no_links(spark):
    assert components.linked_groups(spark.createDataFrame([], "x string, y string"), "x", "y").collect() == []
