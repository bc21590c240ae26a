import itertools
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oremill.llm import blocks, cooccur, simjoin


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(11)
    data = []
    for u in range(120):
        for b in draw.sample(range(30), draw.randint(1, 8)):
            data.append((f"u{u:03d}", f"b{b:02d}", 1))
    data += [(f"u{u:03d}", "hot", 1) for u in range(90)] + [("huge", f"b{b:02d}", 1) for b in range(30)]
    data += [(f"u{u:03d}", f"twin{k}", 1) for k in range(4) for u in range(5)]
    data += data[:50] + [(None, "b01", 1), ("u001", None, 1)]
    return spark.createDataFrame(data, "user_id string, business_id string, item int")


def sets(rows, key, value):
    out = defaultdict(set)
    for r in rows.collect():
        if r[key] is not None and r[value] is not None:
            out[r[key]].add(r[value])
    return out


@pytest.mark.parametrize("block, part", [(1024, 2_000_000), (4, 10), (7, 2_000_000)])
def test_item_pairs_match_brute_force(rows, block, part):
    by = sets(rows, "business_id", "user_id")
    total = len(set().union(*by.values()))
    want = {}
    for a, b in itertools.combinations(sorted(by), 2):
        c = len(by[a] & by[b])
        if c >= 5 and c * total >= 1.2 * len(by[a]) * len(by[b]) - 1e-9:
            want[a, b] = (c, len(by[a]), len(by[b]))
    got = {(r.b1, r.b2): (r.c, r.n1, r.n2) for r in cooccur.item_pairs(rows, least=5, lift=1.2, block_items=block, part_rows=part).collect()}
    assert got == want and len(want) > 5
    every = cooccur.item_pairs(rows, least=5, block_items=block).collect()
    assert {(r.b1, r.b2) for r in every} == {(a, b) for a, b in itertools.combinations(sorted(by), 2) if len(by[a] & by[b]) >= 5}
    assert all(abs(r.lift - r.c * total / (r.n1 * r.n2)) < 1e-9 for r in every)


def test_tile_products():
    """Against dense matrices, in chunks of every size, for a block with itself and with another."""
    draw = np.random.default_rng(4)
    matrix = draw.random((40, 16)) < 0.3
    for width, most in itertools.product((8, 16), (1, 30, 10**6)):
        for lb, rb in ((0, 0), (0, 1), (1, 1))[: 3 if width == 8 else 1]:
            columns = sorted({*range(lb * width, lb * width + width), *range(rb * width, rb * width + width)})
            record, at = np.nonzero(matrix[:, columns])
            code, c = cooccur.tile_product(record, np.array(columns)[at], lb, rb, width, most)
            product = matrix[:, lb * width : lb * width + width].T.astype(int) @ matrix[:, rb * width : rb * width + width].astype(int)
            if lb == rb:
                product = np.triu(product, 1)
            assert {(int(k) // width, int(k) % width): int(n) for k, n in zip(code, c, strict=True)} == {(i, j): int(product[i, j]) for i, j in zip(*np.nonzero(product), strict=True)}


@pytest.mark.parametrize("block_rows", [4096, 3])
def test_similar_sets_match_brute_force(rows, block_rows):
    by = {b: s for b, s in sets(rows, "business_id", "user_id").items() if len(s) >= 3}
    want = {(a, b) for a, b in itertools.combinations(sorted(by), 2) if 2 * len(by[a] & by[b]) >= len(by[a] | by[b])}
    got = simjoin.similar_sets(rows, block_rows=block_rows).collect()
    assert {(r.b1, r.b2) for r in got} == want and len(got) == len(want) >= 6


def test_recall_on_pairs_at_the_threshold(spark):
    """2,000 pairs of sets of three that share two."""
    rows = [(f"{side}{k:04d}", f"u{k:04d}{v}") for k in range(2000) for side, values in (("a", "012"), ("b", "123")) for v in values]
    df = spark.createDataFrame(rows, "business_id string, user_id string")
    assert simjoin.similar_sets(df).count() >= 1998


def test_depth_reaches_the_recall():
    assert simjoin.depth_for(40, 0.5, 0.9999) == 2
    assert simjoin.depth_for(40, 0.5, 0.92) == 4
    with pytest.raises(ValueError, match="recall"):
        simjoin.depth_for(4, 0.5, 0.9999)


def test_empty_tables(rows):
    assert cooccur.item_pairs(rows.limit(0)).collect() == []
    assert simjoin.similar_sets(rows.limit(0)).collect() == []


def test_runs_cut_only_between_groups():
    draw = random.Random(1)
    keys = sorted(draw.choices(range(20), k=200))
    batches, at = [], 0
    while at < 200:
        n = draw.randint(0, 9)
        batches.append(pa.RecordBatch.from_arrays([pa.array(keys[at : at + n], pa.int64())], names=["k"]))
        at += n
    tables = [t.column(0).to_pylist() for t in blocks.runs(iter(batches), 1)]
    assert [k for t in tables for k in t] == keys
    assert all(a[-1] != b[0] for a, b in itertools.pairwise(tables))


def test_every_pair_meets_once(spark):
    """Members of one prefix, cut into blocks, by the neighbours in the order: each pair once."""
    members = spark.createDataFrame([(0, 5, 5 << 32 | i % 3, 4, i, bytes(8)) for i in range(50)], "tree int, prefix long, signature long, size int, member long, sketch binary")
    spread = blocks.block_pairs(members, "member", F.lit(5)).orderBy("left_block", "right_block", "signature")
    rows = spread.select("tree", "prefix", "left_block", "right_block", "signature", "block", "member", "size", "sketch").toArrow()
    seen = [p for b in simjoin._neighbours(iter(rows.to_batches(max_chunksize=7)), 0.5, 0) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted(seen) == list(itertools.combinations(range(50), 2))
