import math
import unicodedata
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from conftest import make_id

from oremill.llm import terms

TEXTS = [
    (1, make_id("a"), "The Soup, the soup! café café so­up 42"),
    (1, make_id("a"), "The Soup, the soup! café café so­up 42"),
    (2, f" {make_id('a')}\n", "soup　bread ​ ... (7)"),
    (3, make_id("b"), None),
    (4, make_id("b"), ""),
    (5, make_id("b"), "1234 !!"),
    (6, "N/A", "the stew"),
    (7, None, "THE END " * 2000),
    (None, make_id("b"), "lost"),
]


def reviews(spark, more=()):
    rows = [(*r, "x", 1) for r in [*TEXTS, *more]]
    return spark.createDataFrame(rows, "review_id long, business_id string, text string, term string, n int")


def brute_terms(text):
    low = unicodedata.normalize("NFC", (text or "").lower())
    for c in terms.DROPPED:
        low = low.replace(c, "")
    return low.split()


def test_terms_of():
    assert terms.terms_of(TEXTS[0][2]) == ["the", "soup", "the", "soup", "café", "café", "soup"]
    assert terms.terms_of(None) == terms.terms_of("") == terms.terms_of(" 12 !") == []


@pytest.mark.parametrize("heavy, flush", [(4096, 300_000), (0, 1), (2, 2)])
def test_counts_match_brute_force_by_either_way(spark, heavy, flush):
    n, r = Counter(), Counter()
    records = {k: t for k, _, t in TEXTS if k is not None}
    for t in records.values():
        n.update(brute_terms(t))
        r.update(set(brute_terms(t)))
    got = {x.term: (x.occurrences, x.records) for x in terms.term_counts(reviews(spark), most_heavy=heavy, flush=flush).collect()}
    assert got.pop(None) == (0, sum(bool(brute_terms(t)) for t in records.values()))
    assert got == {t: (n[t], r[t]) for t in n}


def test_marks(spark):
    got = {r.term: r.mark for r in terms.term_marks(reviews(spark), rare=2, common=0.6).collect()}
    assert got["stew"] == "rare" and got["the"] == "common" and got["soup"] is None
    assert terms.term_marks(reviews(spark).limit(0)).collect() == []


def brute_distinctive(rows, stop, k, least):
    by = defaultdict(Counter)
    texts = Counter()
    for b, t in rows.values():
        words = brute_terms(t)
        if words:
            texts[b] += 1
            by[b].update(w for w in words if w not in stop)
    by = {b: c for b, c in by.items() if c}
    df = Counter(w for c in by.values() for w in c)
    out = set()
    for b, c in by.items():
        if texts[b] >= least:
            scores = sorted((-round(n / max(c.values()) * math.log2(len(by) / df[w]), 6), w) for w, n in c.items())
            out |= {(b, w) for _, w in scores[:k]}
    return out


@pytest.mark.parametrize("share", [None, 3])
def test_distinctive_terms(spark, monkeypatch, share):
    more = [(100 + i, make_id("abcdefgh"[i % 8]), " ".join(f"w{(i * j) % 17}" for j in range(1, 9))) for i in range(120)]
    if share:
        # All groups count as hot, so that they are spread and summed up.
        monkeypatch.setattr(terms, "hot_keys", lambda df, key: spark.createDataFrame([(make_id(c), share) for c in "abcd"], "grp string, pieces int"))
    stop = spark.createDataFrame([(" The ",), ("w0",), (None,)], "value string")
    rows = {k: (b.strip(), t) for k, b, t in [*TEXTS, *more] if k is not None and b and len(b.strip()) == 22}
    got = {(r.grp, r.term) for r in terms.distinctive_terms(reviews(spark, more), stop, least_texts=2).collect()}
    assert got == brute_distinctive(rows, {"the", "w0"}, 3, 2)
    assert terms.distinctive_terms(reviews(spark).limit(0), stop).collect() == []


def test_light_terms_take_the_other_way(spark):
    counts = spark.createDataFrame([("g", "a", 1), ("h", "a", 2), ("h", "b", 3)], "grp string, term string, n long")
    frequencies = spark.createDataFrame([("a", 2, 3), ("b", 1, 3)], "term string, groups long, n long")
    for heavy in (1, 2, 100):
        assert terms.with_frequency(counts, frequencies, heavy).count() == 3


def test_upper_tail_is_exact():
    cases = [(k, n, m, s) for s in (5, 12, 40) for n in (1, 3, s) for m in (1, s // 2, s) for k in range(0, min(n, m) + 1)]
    got = terms.log_upper_tail(*(np.array(x) for x in zip(*cases, strict=True)))
    for x, (k, n, m, s) in zip(got, cases, strict=True):
        p = sum(math.comb(m, i) * math.comb(s - m, n - i) for i in range(k, min(n, m) + 1)) / math.comb(s, n)
        assert math.isclose(math.exp(x), p, rel_tol=1e-9), (k, n, m, s)


def test_upper_tail_loses_nothing_at_any_size():
    """Where the tail is known in closed form, and where it can be worked out in whole numbers, up to sizes of 1e13."""
    for size in (10**6, 10**9, 10**11, 10**13):
        for draws in (1, 17, size // 1000, size // 3):
            one, two, none = terms.log_upper_tail(*np.array([(1, draws, 1, size), (2, draws, 2, size), (1, draws, 2, size)]).T)
            assert math.isclose(one, math.log(draws / size), rel_tol=1e-12)
            if draws > 1:
                assert math.isclose(two, math.log(draws * (draws - 1)) - math.log(size * (size - 1)), rel_tol=1e-12)
            exact = 1 - Fraction((size - draws) * (size - draws - 1), size * (size - 1))
            assert math.isclose(none, math.log(exact.numerator) - math.log(exact.denominator), rel_tol=1e-12)
    for k, draws, marked, size in [(30, 2000, 500, 10**6), (5, 300, 40, 10**9), (12, 100, 1000, 10**13), (3, 5000, 2000, 10**6), (9, 5000, 2000, 10**6)]:
        ways = sum(math.comb(marked, i) * math.comb(size - marked, draws - i) for i in range(k, min(marked, draws) + 1))
        exact = Fraction(ways, math.comb(size, draws))
        want = math.log(exact.numerator) - math.log(exact.denominator) if exact < Fraction(1, 2) else math.log1p(-float(1 - exact))
        assert math.isclose(terms.log_upper_tail(*np.array([[k], [draws], [marked], [size]]))[0], want, rel_tol=1e-10, abs_tol=1e-9), (k, draws, marked, size)


def test_adjustment_is_that_of_benjamini_and_hochberg(spark):
    """With ties, against the plain procedure over one place after the other."""
    rows = [(i, make_id("abc"[i % 3]), " ".join(f"w{(i * j) % 23}" for j in range(1, 10)) + f" own{i % 3}" * (i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "review_id long, business_id string, text string")
    stop = spark.createDataFrame([("x",)], "value string")
    by = defaultdict(Counter)
    for _, b, t in rows:
        by[b].update(brute_terms(t))
    overall = sum(by.values(), Counter())
    size = sum(overall.values())
    want = {}
    for b, held in by.items():
        draws = sum(held.values())
        p = {t: terms.log_upper_tail(*np.array([[n], [draws], [overall[t]], [size]]))[0] for t, n in held.items()}
        order = sorted(p, key=lambda t: (p[t], -held[t], t))
        q = [p[t] + math.log(len(order) / j) for j, t in enumerate(order, 1)]
        want |= {(b, t): (place + 1, round(-min(0.0, *q[place:]) / math.log(10), 6) + 0.0) for place, t in enumerate(order[:4])}
    got = {(r.grp, r.term): (r.place, r.score) for r in terms.enriched_terms(df, stop, k=4).collect()}
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 2e-6 for x in want)


def test_enriched_terms_prefer_what_is_concentrated(spark):
    rows = [(i, make_id("a"), "soup soup bread") for i in range(5)] + [(10 + i, make_id("b"), "stew stew bread") for i in range(5)]
    df = spark.createDataFrame([(k, b, t) for k, b, t in rows], "review_id long, business_id string, text string")
    stop = spark.createDataFrame([("x",)], "value string")
    got = [(r.grp[0], r.term, r.n) for r in terms.enriched_terms(df, stop, k=1).orderBy("grp").collect()]
    assert got == [("a", "soup", 10), ("b", "stew", 10)]
    p = sum(math.comb(10, i) * math.comb(20, 15 - i) for i in range(10, 11)) / math.comb(30, 15)
    score = terms.enriched_terms(df, stop, k=1).first().score
    assert abs(score + math.log10(p * 2)) < 1e-5  # two terms in the group
    assert terms.enriched_terms(df.limit(0), stop).collect() == []
