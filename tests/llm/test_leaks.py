import random

import numpy as np

from oremill.llm import leaks

DRAW = random.Random(9)
WORDS = ["".join(DRAW.choices("abcdefghijklmnop", k=6)) for _ in range(400)]
PASSAGE = " ".join(WORDS[:40]) + "."
CHINESE = "".join(chr(0x4E00 + i * 37) for i in range(80))
NOISE = " ".join(WORDS[100:300])


def carries(text, passage=PASSAGE):
    passages = leaks.Passages([(7, passage)])
    return bool(passages.found([leaks.words_of(text)]))


def test_length_of_a_run():
    assert carries(f"{NOISE} {' '.join(WORDS[5:17])} {NOISE}")
    assert not carries(f"{NOISE} {' '.join(WORDS[5:16])} {NOISE}")
    assert carries(PASSAGE)


def test_surface_does_not_matter():
    part = [w.upper() for w in WORDS[3:17]]
    part[4] = part[4][:2] + "​" + part[4][2:3] + "́" + part[4][3:]
    assert carries("“" + ",\n  ".join(part) + "!”")


def test_one_word_in_eight_may_change():
    for edit in ("replace", "add", "drop"):
        for at in range(1, 15):
            part = WORDS[8:24]
            if edit == "replace":
                part[at] = "quite"
            elif edit == "add":
                part.insert(at, "quite")
            else:
                del part[at]
            assert carries(f"{NOISE} {' '.join(part)} {NOISE}"), (edit, at)
    part = WORDS[0:16]
    part[5], part[11] = "quite", "rather"
    assert carries(" ".join(part))
    for at in range(2, 14, 3):
        part[at] = "quite"
    assert not carries(" ".join(part))


def test_other_order_is_no_case():
    part = WORDS[0:30]
    DRAW.shuffle(part)
    assert not carries(" ".join(part))


def test_scripts_without_spaces():
    assert carries("前文" + CHINESE[10:40] + "后文", CHINESE)
    assert not carries("前文" + CHINESE[10:39] + "后文", CHINESE)
    edited = list(CHINESE[0:48])
    edited[10], edited[22], edited[35] = "一", "一", "一"
    assert carries("，".join(edited), CHINESE)


def test_index_finds_all_within_the_radius():
    draw = np.random.default_rng(3)
    prints = draw.integers(0, 2**63, 500, dtype=np.uint64)
    queries = prints[:100].copy()
    for i in range(100):
        for b in draw.choice(64, i % 4, replace=False):
            queries[i] ^= np.uint64(1) << np.uint64(b)
    q, p = leaks.HammingIndex(prints).near(queries)
    assert {(i, i) for i in range(100)} <= set(zip(q.tolist(), p.tolist(), strict=True))


def test_fingerprints_do_not_depend_on_the_place():
    hashes = leaks.hashed(WORDS[:30])
    assert (leaks.fingerprints(hashes, 5)[4:] == leaks.fingerprints(hashes[4:], 5)).all()
    assert len(leaks.fingerprints(hashes[:4], 5)) == 0


def test_operator(spark):
    docs = spark.createDataFrame([(1, f"x {PASSAGE} y", 0), (1, f"x {PASSAGE} y", 0), (2, None, 0), (3, "", 0), (4, NOISE * 50 + " " + PASSAGE, 0), (None, PASSAGE, 0), (5, CHINESE, 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(70, PASSAGE, "p"), (71, PASSAGE, "p"), (72, None, "p"), (73, "too short", "p"), (74, CHINESE, "p"), (None, PASSAGE, "p")], "item_id long, passage string, text string")
    got = sorted(leaks.leaked(docs, items).collect())
    assert got == [(1, 70), (1, 71), (4, 70), (4, 71), (5, 74)]
    assert leaks.leaked(docs.limit(0), items).collect() == leaks.leaked(docs, items.limit(0)).collect() == []


def test_dense_edits_in_single_characters():
    for sizes in ((6, 5, 6, 5, 6), (6, 6, 6, 6, 5, 6), (6, 6, 6, 6, 6, 6, 6)):
        part = list(CHINESE[10 : 10 + sum(sizes) + len(sizes) - 1])
        at = -1
        for size in sizes[:-1]:
            at += size + 1
            part[at] = "龘"
        assert carries(f"{NOISE} {''.join(part)} {NOISE}", CHINESE), sizes


def edited(part, edit, every, start):
    """One in `every` words or characters replaced, added or missing, evenly spread; edits outside the run's ends only."""
    out = []
    for i, w in enumerate(part):
        if i % every == start and 0 < i < len(part) - 1:
            if edit == "add":
                out += [w, "龘" if len(w) == 1 else "quite"]
            elif edit == "replace":
                out.append("龘" if len(w) == 1 else "quite")
        else:
            out.append(w)
    return out


def test_runs_of_every_length_with_one_edit_in_eight():
    for n in range(12, 61):
        for edit in ("replace", "add", "drop"):
            for start in (3, 4, 5):
                part = edited(WORDS[:n], edit, 8, start)
                if 8 * sum(i % 8 == start and 0 < i < n - 1 for i in range(n)) <= n:
                    assert carries(f"{NOISE} {' '.join(part)} {NOISE}", " ".join(WORDS[:90])), (n, edit, start)
    for n in range(30, 65):
        for edit in ("replace", "add", "drop"):
            for start in (2, 4, 6):
                part = edited(CHINESE[5 : 5 + n], edit, 8, start)
                if 8 * sum(i % 8 == start and 0 < i < n - 1 for i in range(n)) <= n:
                    assert carries(f"{NOISE} {''.join(part)} {NOISE}", CHINESE), (n, edit, start)


def test_pieces_decide_as_the_longest_run_does():
    """Random edits of any density, against the plain rule over all runs of the item and all parts of the text."""
    draw = random.Random(12)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row

    item = WORDS[:34]
    passages = leaks.Passages([(1, " ".join(item))])
    cases = found = 0
    for _ in range(120):
        start, n = draw.randint(0, 10), draw.randint(10, 24)
        text = [w for w in item[start : start + n]]
        for _ in range(draw.randint(0, 4)):
            at = draw.randrange(len(text))
            text[at : at + 1] = draw.choice([["quite"], [text[at], "rather"], []])
        want = False
        for a in range(len(text)):
            for p in range(len(item)):
                for q in range(p + 12, len(item) + 1):
                    if text[a : a + 1] == item[p : p + 1]:
                        want = want or any(8 * x <= q - p and text[a + j - 1 : a + j] == item[q - 1 : q] for j, x in enumerate(distance(item[p:q], text[a : a + q - p + 4])) if j)
                if want:
                    break
            if want:
                break
        got = bool(passages.found([text]))
        assert got == want, text
        cases, found = cases + 1, found + got
    assert 10 < found < cases - 10
