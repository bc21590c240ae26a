import math
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oremill.functions.shared import written
from oremill.operators import cf, content, nearest
from oremill.operators.nearest import predicted
from oremill.operators.similarity import seeded_signatures

STOP = [("the",), ("",)]


def reviews(spark):
    rows = [("u1", "b1", "Pizza pizza, THE best"), ("u1", "b1", "Pizza pizza, THE best"), ("u2", "b1", "pizza 42"), ("u2", "b2", "sushi　best"), ("u3", "b3", None), ("u3", "b3", "...")]
    return spark.createDataFrame([(*r, 1) for r in rows], "user_id string, business_id string, text string, n int")


def test_profiles(spark):
    stop = spark.createDataFrame(STOP, "word string")
    got = {(r.business_id, r.word): (r.score, r["rank"]) for r in content.tfidf_profile(reviews(spark), stop).collect()}
    assert got == {("b1", "pizza"): (round(math.log2(3), 6), 1), ("b1", "best"): (round(math.log2(3 / 2) / 3, 6), 2), ("b2", "sushi"): (round(math.log2(3), 6), 1), ("b2", "best"): (round(math.log2(3 / 2), 6), 2)}
    plain = sorted(map(tuple, content.document_words(reviews(spark), stop).collect()))
    assert plain == [("b1", "best", 1), ("b1", "pizza", 3), ("b2", "best", 1), ("b2", "sushi", 1)]
    assert plain == sorted(map(tuple, content.document_words(reviews(spark), stop, hot=1).collect()))
    for heavy in (1, 2):
        assert got == {(r.business_id, r.word): (r.score, r["rank"]) for r in content.tfidf_profile(reviews(spark), stop, most_heavy=heavy).collect()}
    profile = content.tfidf_profile(reviews(spark), stop)
    users = content.user_profile(reviews(spark), profile, 2)
    assert [(r.user_id, r.word) for r in users.orderBy("user_id", "rank").collect()] == [("u1", "best"), ("u1", "pizza"), ("u2", "best"), ("u2", "pizza")]
    assert sorted(map(tuple, content.user_profile(reviews(spark), profile, 2, hot=1).collect())) == sorted(map(tuple, users.collect()))
    pairs = spark.createDataFrame([("u1", "b2"), ("u1", "b2"), ("u3", "b1"), ("u1", None)], "user_id string, business_id string")
    assert [tuple(r) for r in content.content_scores(pairs, users, profile).collect()] == [("u1", "b2", 0.5)] * 2
    assert content.tfidf_profile(reviews(spark).limit(0), stop).collect() == []


RATINGS = [("u1", "a", 5), ("u2", "a", 3), ("u3", "a", 4), ("u4", "a", 1), ("u1", "b", 4), ("u2", "b", 1), ("u3", "b", 5), ("u4", "b", 2), ("u1", "c", 2), ("u2", "c", 5), ("u3", "c", 1), ("u4", "c", 3), ("u1", "c", 1), ("u5", "c", None)]


def raw(x, y):
    mx, my = sum(x) / len(x), sum(y) / len(y)
    return sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / (math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(b * b for b in y)))


@pytest.fixture
def ratings(spark):
    return spark.createDataFrame([(u, b, None if s is None else float(s)) for u, b, s in RATINGS], "user_id string, business_id string, stars double")


def test_item_similarity_centres_only_above(ratings):
    got = {(r.b1, r.b2): r.sim for r in cf.item_similarity(ratings).collect()}
    assert got == {("a", "b"): round(raw([5, 3, 4, 1], [4, 1, 5, 2]), 6)}
    assert cf.item_similarity(ratings, min_common=5).collect() == []
    assert cf.item_similarity(ratings, norm="centered").first().sim > got["a", "b"]
    with pytest.raises(ValueError):
        cf.item_similarity(ratings, norm="x")


def test_user_similarity(ratings):
    got = {(r.u1, r.u2): r.sim for r in cf.user_similarity(ratings).collect()}
    v = {"u1": [5, 4, 2], "u2": [3, 1, 5], "u3": [4, 5, 1], "u4": [1, 2, 3]}
    want = {(a, b): round(raw(v[a], v[b]), 6) for a in v for b in v if a < b and raw(v[a], v[b]) > 0}
    assert got == want
    assert set(cf.user_similarity(ratings, mode="minhash").collect()) <= set(cf.user_similarity(ratings).collect())


def test_item_prediction(spark, ratings):
    model = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.25), ("b", "d", 0.1)], "b1 string, b2 string, sim double")
    pairs = spark.createDataFrame([("u1", "a"), ("u1", "a"), ("u9", "a"), ("u1", "d"), ("u1", "z"), (None, "a")], "user_id string, business_id string")
    got = {(r.user_id, r.business_id): r.stars for r in cf.predict_item_based(pairs, ratings, model).collect()}
    assert got == {("u1", "a"): round((4 * 0.5 + 2 * 0.25) / 0.75, 6), ("u1", "d"): 4.0}
    assert cf.predict_item_based(pairs, ratings, model, 1).where("business_id = 'a'").first().stars == 4.0


def test_user_prediction_needs_neighbours(spark, ratings):
    model = spark.createDataFrame([("u1", "u2", 0.5), ("u1", "u3", 0.4), ("u1", "u4", 0.1)], "u1 string, u2 string, sim double")
    pairs = spark.createDataFrame([("u1", "a"), ("u2", "a")], "user_id string, business_id string")
    got = {(r.user_id, r.business_id): r.stars for r in cf.predict_user_based(pairs, ratings, model).collect()}
    shift = ((3 - 3) * 0.5 + (4 - 10 / 3) * 0.4 + (1 - 2) * 0.1) / 1.0
    assert got == {("u1", "a"): round(11 / 3 + shift, 6)}


def unshuffled(found):
    plan = found._jdf.queryExecution().executedPlan().toString()
    return "hashpartitioning(left" not in plan and "hashpartitioning(right" not in plan


def test_items_are_paired_in_tiles(ratings):
    """Pairs of businesses are not shuffled to be made distinct, counted or looked up."""
    assert unshuffled(cf.item_similarity(ratings))


def test_minhash_users_are_paired_in_tiles(spark):
    """The minhash model is whole: all pairs of the exact one that are pairs of user_lsh_pairs, and others are left out. Its pairs are not shuffled."""
    rows = [(f"u{u:02d}", f"b{(u * u + 7 * k * (u % 5 + 1)) % 97:02d}", float((u + 3 * k) % 5 + 1)) for u in range(40) for k in range(12)]
    ratings = spark.createDataFrame(rows, "user_id string, business_id string, stars double")
    exact = {(r.u1, r.u2): r.sim for r in cf.user_similarity(ratings).collect()}
    near = set(map(tuple, cf.user_lsh_pairs(ratings, n=2).collect()))
    model = cf.user_similarity(ratings, mode="minhash", n=2)
    assert unshuffled(model)
    got = {(r.u1, r.u2): r.sim for r in model.collect()}
    assert got == {k: v for k, v in exact.items() if k in near} and 0 < len(got) < len(exact)


def test_users_are_paired_in_tiles(ratings):
    """Pairs of users are not shuffled to be made distinct, counted, looked up or compared in size."""
    found = cf.user_similarity(ratings)
    assert unshuffled(found) and found.count() > 0


def test_user_lsh_pairs_are_not_shuffled(ratings):
    """All pairs of users with an equal hash in a band, each once; no pair is shuffled."""
    found = cf.user_lsh_pairs(ratings, n=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert unshuffled(found) and "hashpartitioning(b1" not in plan and "hashpartitioning(u1" not in plan
    by = {}
    for r in seeded_signatures(cf.one_rating(ratings).where("user_id in ('u1', 'u2', 'u3', 'u4')"), 3).collect():
        by.setdefault((r.band, r.hash), set()).add(r.id)
    assert sorted(map(tuple, found.collect())) == sorted({(a, b) for held in by.values() for a in held for b in held if a < b})


def by_hand(wanted, rated, model, k, least):
    """predict_user_based, written as loops; repeated rows of the model count as often as they come."""
    of = {}
    for u, b, s in rated:
        of.setdefault(u, {})[b] = max(s, of.get(u, {}).get(b, 0.0))
    near = [x for u1, u2, sim in model for x in ((u1, u2, sim), (u2, u1, sim))]
    out = {}
    for u, b in set(wanted):
        top = sorted((-sim, o, of[o][b]) for x, o, sim in near if x == u and b in of.get(o, {}))[:k]
        both = [(-sim, stars, [of[o][c] for c in of.get(u, {}) if c in of[o]]) for sim, o, stars in top]
        both = [x for x in both if x[2]]
        weight = sum(sim for sim, *_ in both)
        if len(both) >= least and weight:
            mean = sum(of[u].values()) / len(of[u]) + sum((s - sum(c) / len(c)) * sim for sim, s, c in both) / weight
            if mean >= 0:
                out[u, b] = round(mean, 6)
    return out


def prediction_case():
    """Users of whom some want what they didn't rate, with many equal similarities."""
    rated = [(f"u{u:02d}", f"b{(u * u + 5 * k * (u % 4 + 1)) % 31:02d}", float((u + 3 * k) % 5 + 1)) for u in range(30) for k in range(9)]
    model = [(f"u{a:02d}", f"u{b:02d}", ((a * b) % 4) / 4 + 0.25) for a in range(30) for b in range(a + 1, 32) if (a + b) % 3]
    wanted = [(u, b) for u, b, _ in rated if u < "u25"] + [(f"u{u:02d}", f"b{(3 * u) % 31:02d}") for u in range(32)] + [("u01", "zz"), ("zz", "b01"), ("u01", None)]
    return wanted, rated, model


def test_user_predictions_by_hand(spark):
    """The same in one block and in several; neither what users want and their neighbours nor what they share is shuffled to be joined."""
    wanted, rated, model = prediction_case()
    ratings = spark.createDataFrame([*rated, *rated[:20], ("u01", "b01", float("nan")), ("u02", None, 3.0)], "user_id string, business_id string, stars double")
    pairs = spark.createDataFrame(wanted, "user_id string, business_id string")
    frame = spark.createDataFrame(model, "u1 string, u2 string, sim double")
    for k, least in ((11, 3), (2, 1)):
        found = cf.predict_user_based(pairs, ratings, frame, k, least)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(user_id" not in plan and "hashpartitioning(other" not in plan
        got = {(r.user_id, r.business_id): r.stars for r in found.collect()}
        want = by_hand(wanted, rated, model, k, least)
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want) and len(want) > 100
        parts = predicted(pairs, cf.one_rating(ratings), frame, k, least, blocks=3).collect()
        assert {(r.user_id, r.business_id) for r in parts} == want.keys() and len(parts) == len(want)


def test_user_predictions_in_pieces(monkeypatch):
    """A block taken in small pieces of work, some of them one user in several, gives what it gives at once. Null similarities come last and weigh nothing."""
    wanted, rated, model = prediction_case()
    users, shops = sorted({u for u, *_ in rated}), {b: i for i, b in enumerate(sorted({b for _, b, _ in rated}))}
    rows = [{"link": True, "id": a, "other": b, "sim": s, "items": [], "stars": [], "wanted": []} for x, y, s in [*model, ("u03", "u04", None)] for a, b in ((x, y), (y, x))]
    for u in users:
        stars, want = {b: s for x, b, s in rated if x == u}, {b for x, b in wanted if x == u and b in shops}
        held = sorted((shops[b], stars.get(b, float("nan")), int(b in want)) for b in {*stars, *want})
        rows.append({"link": False, "id": u, "other": u, "sim": 0.0, **dict(zip(("items", "stars", "wanted"), map(list, zip(*held, strict=True)), strict=True))})
    table = pa.Table.from_pylist(rows)

    def of(most):
        monkeypatch.setattr(nearest, "MOST", most)
        return {(u, i): s for ids, items, stars in nearest._block(table, 4, 2) for u, i, s in zip(ids.to_pylist(), items.tolist(), stars.tolist(), strict=True)}

    assert of(5) == pytest.approx(of(1 << 20)) and len(of(5)) > 100


def test_written_tables_leave_no_shuffle(spark):
    """The shuffles that make a written table are deleted once it is made, and the session's setting is as before."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, disk = spark.conf.get(key), spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f for f in disk.getAllFiles().mkString("|").split("|") if "/shuffle_" in f}
    old = held()
    table = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    for _ in range(50):
        if held() <= old:
            break
        time.sleep(0.1)
    assert held() <= old and spark.conf.get(key) == before
    assert table.count() == 7
