import os
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oremill.operators.multivalue import SEPARATORS, split_values, splitting_rule
from oremill.plans import catalogue

NAMES = ["Bags, Belts & Buckles", "Bed/Sofa Stores", "Sand; Salt & Gravel", 'The "Quiet" Lounges', "Men's Tailors", "Tea Rooms"]

CASES = [
    ("Tea Rooms, Dentists", ["Tea Rooms", "Dentists"]),
    ("Tea Rooms", ["Tea Rooms"]),
    ('"Tea Rooms"', ["Tea Rooms"]),
    ("  ", []),
    ("", []),
    (None, []),
    (", ,;|", []),
    ("A,,B", ["A", "B"]),
    ("Bags, Belts & Buckles, Barbers", ["Bags, Belts & Buckles", "Barbers"]),
    ("BAGS, BELTS & BUCKLES;barbers", ["BAGS, BELTS & BUCKLES", "barbers"]),
    ('["Bed/Sofa Stores","The \\"Quiet\\" Lounges", "Spa"]', ["Bed/Sofa Stores", 'The "Quiet" Lounges', "Spa"]),
    ('"The ""Quiet"" Lounges", Spa', ['The "Quiet" Lounges', "Spa"]),
    ('Spa | The "Quiet" Lounges', ["Spa", 'The "Quiet" Lounges']),
    ("Bags\\, Belts & Buckles; Odd\\, Name", ["Bags, Belts & Buckles", "Odd, Name"]),
    ("“Odd; One” / ‘Two, Three’ · Four", ["Odd; One", "Two, Three", "Four"]),
    ("'Odd, One','Men's Tailors'", ["Odd, One", "Men's Tailors"]),
    ("Men's Tailors、Dogs' Home", ["Men's Tailors", "Dogs' Home"]),
    ("A\n B \n\nC\tD", ["A", "B", "C", "D"]),
    ('"unclosed, B', ['"unclosed', "B"]),
    ("Sand; Salt & Gravel;Tea Rooms", ["Sand; Salt & Gravel", "Tea Rooms"]),
    ("x, " * 3000, ["x"] * 3000),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, t, "p", "s") for i, (t, _) in enumerate(CASES)], "id int, field string, rule string, skeleton string")
    got: dict[int, list] = {}
    for r in split_values(df, "field", NAMES).orderBy("id", "pos").collect():
        assert (r["rule"], r["skeleton"]) == ("p", "s")
        got.setdefault(r.id, []).append((r.pos, r.value))
    for i, (text, values) in enumerate(CASES):
        assert got.get(i, []) == list(enumerate(values, 1)), text


def test_rare_skeletons_take_the_other_way(spark):
    df = spark.createDataFrame([(1, "A;B"), (2, "A;B"), (3, '"A"|B')], "id int, field string")
    rows = split_values(df, "field", NAMES, most_broadcast=1).orderBy("id", "pos").collect()
    assert [(r.id, r.value) for r in rows] == [(1, "A"), (1, "B"), (2, "A"), (2, "B"), (3, "A"), (3, "B")]


def test_empty_table_and_clash(spark):
    df = spark.createDataFrame([], "id int, field string, pos int")
    assert split_values(df.drop("pos"), "field", []).collect() == []
    with pytest.raises(ValueError):
        split_values(df, "field", [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab ", min_size=1).filter(str.strip), min_size=1, max_size=6), st.sampled_from(SEPARATORS))
def test_quoting_round_trip(values, sep):
    """Values written in quotes come back, whatever separator stands between."""
    skeleton, want, at = "", [], 0
    for i, _ in enumerate(values):
        skeleton += (sep if i else "") + '"x"'
        want.append([at + (2 if i else 1)])
        at += 4 if i else 3
    assert splitting_rule(skeleton) == want


def test_names_of_any_length_and_common_beginnings(spark):
    """The longest name that fits wins, also behind a shorter one that begins like it; a name may be very long."""
    names = ["Ham, Egg", "Ham, Egg & Tea", "Ham, Eggs", "Ham / Rye", "x" * 3000 + ", y", "Plain"]
    field = "ham, egg & tea, Ham, Eggs; HAM / RYE / ham, egg, " + "X" * 3000 + ", Y, Ham, Eggcup"
    rows = spark.createDataFrame([(1, field)], "id int, f string")
    got = [r.value for r in split_values(rows, "f", names).orderBy("pos").collect()]
    assert got == ["ham, egg & tea", "Ham, Eggs", "HAM / RYE", "ham, egg", "X" * 3000 + ", Y", "Ham", "Eggcup"]


def read_by_hand(field, names):
    """One character after the other, without tokens, skeletons or rules."""
    known = sorted((n.lower() for n in names), key=len, reverse=True)
    separators, quotes = ",;|/\n\r\t·•、，；｜／", {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»", "„": "“”"}
    s = field.strip()
    if len(s) > 1 and s[0] == "[" and s[-1] == "]":
        s = s[1:-1]

    def name_at(i):
        if i and (s[i - 1].isalnum()):
            return 0
        for n in known:
            j = i
            for c in n:
                if c in separators and s[j : j + 1] == "\\":
                    j += 1
                if c == '"' and s[j : j + 2] in ('\\"', '""'):
                    j += 1
                if s[j : j + 1].lower() != c:
                    break
                j += 1
            else:
                if not s[j : j + 1].isalnum():
                    return j - i
        return 0

    def ends(i):
        rest = s[i:].lstrip(" ")
        return not rest or rest[0] in separators

    def closing(i):
        close, j, first = quotes[s[i]], i + 1, True
        while j < len(s):
            if n := name_at(j):
                j += n
            elif s[j] == "\\":
                j += 2
            elif s[j] in close and s[j + 1 : j + 2] == s[j] and not (first and ends(j + 1)):
                j += 2
            elif s[j] in close and ends(j + 1):
                return j
            else:
                j += 1
            first = False
        return -1

    def clean(x):
        out, i = "", 0
        while i < len(x):
            if x[i] == "\\" and i + 1 < len(x):
                i += 1
            elif x[i : i + 2] == '""':
                i += 1
            out += x[i]
            i += 1
        return out.strip()

    values, i, value, fresh = [], 0, "", True
    while i < len(s):
        if fresh and s[i] == " ":
            i += 1
        elif n := name_at(i):
            value, i, fresh = value + s[i : i + n], i + n, False
        elif s[i] in separators:
            values.append(value)
            value, fresh, i = "", True, i + 1
        elif fresh and s[i] in quotes and (end := closing(i)) >= 0:
            value, i, fresh = s[i + 1 : end], end + 1, False
        elif s[i] == "\\" and i + 1 < len(s):
            value, i, fresh = value + s[i : i + 2], i + 2, False
        else:
            value, i, fresh = value + s[i], i + 1, False
    return [v for v in map(clean, [*values, value]) if v]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_whole_table_against_reading_by_hand(spark):
    at = "/root/testdata/sf0.01"
    names = [r[0] for r in spark.read.parquet(f"{at}/category_ref.parquet").select("category_name").collect()]
    want, rows = {}, spark.read.parquet(f"{at}/business.parquet").select("business_id", "categories").collect()
    for r in rows:
        key = (r.business_id or "").strip()
        if re.fullmatch("[A-Za-z0-9_-]{22}", key):
            want[key] = max(want.get(key) or "", r.categories or "")
    want = {(k, i, v) for k, field in want.items() for i, v in enumerate(read_by_hand(field, names), 1)}
    got = {tuple(r) for r in catalogue.p2_found(spark, at).select("business_id", "pos", "category").collect()}
    assert len(want) > 4000 and got == want
