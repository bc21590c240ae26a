"""Queries over small folders of tables, against results worked out here: nothing of the whole job may be cut."""

import datetime
import itertools

import pytest
from conftest import make_id

from oremill.plans import catalogue

REVIEW = "review_id bigint, user_id string, business_id string, stars double, date string, text string, loaded_at timestamp"
LOADED = datetime.datetime(2020, 1, 1)


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables, each (name, rows, schema), and names their folder."""

    def write(*tables):
        for name, rows, schema in tables:
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_frequent_businesses_of_every_size(spark, folder):
    shops = [make_id(f"b{i}") for i in range(6)]
    baskets = {make_id(f"u{k}"): shops[:5] if k < 11 else shops[2:] for k in range(21)}
    pairs = [(u, b) for u, held in baskets.items() for b in held]
    rows = [(i, u, b, 3.0, "2014-01-01", "x", LOADED) for i, (u, b) in enumerate(pairs)]
    counts = {s: sum(set(s) <= set(held) for held in baskets.values()) for k in range(1, 7) for s in itertools.combinations(shops, k)}
    want = {(",".join(s), len(s), n) for s, n in counts.items() if n >= 10}
    got = catalogue.frequent_businesses(spark, folder(("review", rows, REVIEW))).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert max(size for _, size, _ in want) == 5


def test_profiles_keep_200_words(spark, folder):
    # Each business has 220 words that no other has, so that all score alike and ties go by word.
    words = ["".join(x) for x in itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=2)]
    shops = {make_id("b1"): words[:220], make_id("b2"): words[220:440]}
    one, both = make_id("u1"), make_id("u2")
    visits = [(one, make_id("b1")), (both, make_id("b1")), (both, make_id("b2"))]
    rows = [(i, u, b, 3.0, "2014-01-01", " ".join(shops[b]), LOADED) for i, (u, b) in enumerate(visits)]
    at = folder(("review", rows, REVIEW), ("stopwords", [("the",)], "value string"))
    got = {(r.user_id, r.word, r["rank"]) for r in catalogue.user_profile(spark, at).collect()}
    assert got == {(u, w, k) for u in (one, both) for k, w in enumerate(words[:200], 1)}
    # The second user's 200 words are the first business's, so that nothing is left in common with the other.
    assert {tuple(r) for r in catalogue.content_scores(spark, at).collect()} == {(one, make_id("b1"), 1.0), (both, make_id("b1"), 1.0)}


def test_content_scores_use_words_past_the_20th(spark, folder):
    words = ["".join(x) for x in itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=2)]
    shops = {make_id("b1"): words[:40], make_id("b2"): words[40:100]}
    user = make_id("u1")
    rows = [(i, user, b, 3.0, "2014-01-01", " ".join(held), LOADED) for i, (b, held) in enumerate(shops.items())]
    at = folder(("review", rows, REVIEW), ("stopwords", [("the",)], "value string"))
    want = {(user, b, round(len(held) / (100 * len(held)) ** 0.5, 6)) for b, held in shops.items()}
    assert {tuple(r) for r in catalogue.content_scores(spark, at).collect()} == want


def test_reviews_count_unless_they_lack_an_id_the_query_needs(spark, folder):
    u1, u2, b1, b2 = (make_id(x) for x in ("u1", "u2", "b1", "b2"))
    full = [(u1, b1, "ale"), (u2, b1, "ale"), (u1, b2, "rye")]
    lacking = [(None, b1, "ale bun"), ("unknown", b1, "ale"), (" ", b2, "bun"), (u2, "n/a", "bun"), (u2, None, "bun"), (None, None, "rye")]
    rows = [(i, u, b, 5.0 if u in (u1, u2) else 2.0, "2014-01-01", t, LOADED) for i, (u, b, t) in enumerate(full + lacking)]
    again = [(*rows[3][:6], datetime.datetime(2021, 1, 1))]
    places = [(b1, "Pub", "NV"), (b2, "Deli", "NV")]
    at = folder(("review", rows + again, REVIEW), ("stopwords", [("the",)], "value string"), ("business", places, "business_id string, categories string, state string"))

    def of(name):
        return sorted(tuple(r) for r in catalogue.queries()[name](spark, at).collect())

    assert of("review_total") == of("reviews_in_year") == [(9,)]
    assert of("distinct_users") == [(2,)]
    assert of("top_users") == [(u1, 2), (u2, 3)]
    assert of("top_words") == of("top_words_not_empty") == [("ale", 4), ("bun", 4), ("rye", 2)]
    assert of("category_avg_stars") == [("Deli", 3.5), ("Pub", 3.5)]
    assert sum(n for _, n in of("partition_sizes_default")) == 9
    assert sum(n for _, n in of("partition_sizes_custom")) == 6
    assert of("state_pairs") == sorted((u, b) for u, b, _ in full)
    assert of("word_document_frequency") == [("ale", 1), ("bun", 2), ("rye", 1)]
    assert [(b, w) for b, w, *_ in of("business_profile")] == [(b1, "ale"), (b1, "bun"), (b2, "bun"), (b2, "rye")]
    assert {(u, b) for u, b, _ in of("content_scores")} == {(u, b) for u, b, _ in full}
    assert {u for u, *_ in of("user_profile")} == {u1, u2}
