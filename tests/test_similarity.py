import random

import pytest

from oremill.operators import similarity
from oremill.operators.pairs import met, shared_groups


@pytest.fixture(scope="module")
def sets(spark):
    draw = random.Random(5)
    return spark.createDataFrame([(f"b{b:02d}", f"u{u:02d}") for b in range(25) for u in draw.sample(range(40), draw.randint(1, 12))], "business_id string, user_id string")


def by_record(sets):
    out: dict = {}
    for r in sets.collect():
        out.setdefault(r.business_id, set()).add(r.user_id)
    return out


def test_dense_index(spark):
    df = spark.createDataFrame([(f"k{i % 50:02d}",) for i in range(200)] + [(None,)], "k string").repartition(6)
    assert [r.i for r in similarity.dense_index(df, "k", "i").orderBy("k").collect()] == list(range(50))


def test_signatures_follow_the_formula(sets):
    data = by_record(sets)
    users = sorted(set().union(*data.values()))
    m, p = len(users), 26189
    got = {(r.id, r.band): r.hash for r in similarity.minhash_signatures(sets, n=8, start_hash=0).collect()}
    for b, held in data.items():
        for i in range(8):
            h = min(((i * ((5 * j + 2) % m) + i * (((3 * j + 3) % p) % m) + i * i) % p) % m for j in map(users.index, held))
            assert got[b, i] == h
    assert {h for (_, band), h in got.items() if band == 0} == {0}  # all records meet in band 0


def test_jaccard(spark, sets):
    data = by_record(sets)
    want = {}
    for a in data:
        for b in data:
            if a < b and len(data[a] & data[b]) / len(data[a] | data[b]) >= 0.2:
                want[a, b] = round(len(data[a] & data[b]) / len(data[a] | data[b]), 6)
    got = {(r.b1, r.b2): r.sim for r in similarity.jaccard_pairs(sets.unionByName(sets), 0.2).collect()}
    assert got == want
    near = similarity.lsh_pairs(similarity.minhash_signatures(sets, start_hash=0))
    assert {(r.b1, r.b2): r.sim for r in similarity.jaccard_pairs(sets, 0.2, near).collect()} == want
    with pytest.raises(ValueError):
        similarity.jaccard_pairs(sets, 0)
    assert similarity.jaccard_pairs(sets.limit(0)).collect() == []


def test_seeded_signatures_repeat(sets):
    one = similarity.seeded_signatures(sets, n=5, seed=1).orderBy("id", "band").collect()
    assert one == similarity.seeded_signatures(sets, n=5, seed=1).orderBy("id", "band").collect()
    assert one != similarity.seeded_signatures(sets, n=5, seed=2).orderBy("id", "band").collect()


def test_large_groups_are_cut_into_blocks(spark, sets):
    """The same result whatever the size of the blocks, for members with one common group and with several."""
    rows = sets.selectExpr("business_id as m", "user_id as g", "cast(length(business_id || user_id) + hash(business_id, user_id) % 5 as double) as v")
    held: dict = {}
    for r in rows.collect():
        held.setdefault(r.m, {})[r.g] = r.v
    for least in (1, 2, 3):
        want = {}
        for a in held:
            for b in held:
                common = held[a].keys() & held[b].keys()
                if a < b and len(common) >= least:
                    want[a, b] = (len(common), sum(held[a][g] for g in common), sum(held[b][g] for g in common), sum(held[a][g] * held[b][g] for g in common))
        for block in (1, 3, 1000):
            got = {(r.left, r.right): (r.n, r.sx, r.sy, r.sxy) for r in shared_groups(rows, "m", "g", least, "v", block=block).collect()}
            assert want and got == want, (least, block)


def test_three_hot_groups(spark):
    """No join key of any of three groups that all members are in has more than its blocks' pairs, and the result is whole."""
    users = [f"u{i:03d}" for i in range(120)]
    rows = spark.createDataFrame([(u, g) for u in users for g in ("h1", "h2", "h3")] + [(u, f"own{u}") for u in users], "m string, g string")
    pairs = met(rows, ["g"], "m", block=10)
    assert pairs.count() == 3 * 120 * 119 // 2
    for least in (1, 2, 3):
        got = shared_groups(rows, "m", "g", least, block=10)
        assert got.count() == 120 * 119 // 2 and {r.n for r in got.collect()} == {3}
    assert shared_groups(rows, "m", "g", 4, block=10).collect() == []


def test_lsh_buckets_of_any_size(spark, sets):
    signatures = similarity.minhash_signatures(sets, n=6)
    by: dict = {}
    for r in signatures.collect():
        by.setdefault((r.band, r.hash), []).append(r.id)
    want = {(a, b) for held in by.values() for a in held for b in held if a < b}
    assert sorted(map(tuple, similarity.lsh_pairs(signatures).collect())) == sorted(want)


def test_lsh_pairs_are_not_shuffled(sets):
    """Pairs are found in tiles, each once: their number doesn't count on disk. Blocks of any size give the same."""
    signatures = similarity.minhash_signatures(sets, n=12)
    found = similarity.lsh_pairs(signatures)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(b1" not in plan and "hashpartitioning(left" not in plan
    want = sorted(map(tuple, found.collect()))
    assert len(want) == len(set(want)) > 50
    for block in (1, 4, 1000):
        assert sorted(map(tuple, similarity.lsh_pairs(signatures, block).collect())) == want


def test_marks_of_any_size(spark):
    """Bands and hashes below 0 and beyond an int, several hashes of a band, repeated rows, ids without a partner."""
    rows = [("a", -3, -(1 << 40)), ("b", -3, -(1 << 40)), ("b", -3, -(1 << 40)), ("c", -3, 1 << 40), ("b", -3, 1 << 40), ("c", 7, 1 << 40), ("d", 7, 5), (None, 7, 5), ("e", None, 5)]
    signatures = spark.createDataFrame(rows, "id string, band int, hash bigint")
    for block in (None, 1, 2):
        assert sorted(map(tuple, similarity.lsh_pairs(signatures, block).collect())) == [("a", "b"), ("b", "c")]
    assert similarity.lsh_pairs(signatures.limit(0)).collect() == []
