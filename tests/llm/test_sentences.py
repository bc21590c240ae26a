import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oremill.llm.sentences import _Block, sentences, sentences_of

#: Texts whose sentences are set apart by " ¦ ".
CASES = [
    "Dr. Reed paid $6.50 for it, approx. half. ¦ J. K. Lane opened the shop at 14 St. Mary Street in approx. 1987. ¦ Version 2.4 lost my booking vs. version 1.5.",
    "They sell bread, rice, etc. ¦ They close at 9 p.m. ¦ The K.L.N. Hall seats 30, incl. my sister. ¦ We shared bread, etc. and left at 10 p.m. with rice.",
    "It was founded in 1955. ¦ What a day! ¦ No way!!! ¦ Do they take cards?! ¦ Great.",
    "The file menu.v2.pdf lists it at 3.25. ¦ See fig. 3 and vol. 2 of the guide, ed. by Prof. Lane. ¦ The Rook Co. branch is closed, the Lane Inc. one is not.",
    "“Never again!” said the twins. ¦ He answered, “We have no curry.” ¦ The table shook. ¦ “We have none today.” ¦ Their sign said “Open daily. Ring twice.” and my uncle rang.",
    "\"Is it nice? I doubt it,\" my sister said. ¦ She whispered, ‘It is nice. Eat!’ and passed it. ¦ (The bar was closed when we came.) ¦ The menu (what a list!) had two kinds (not at 11.15!). ¦ Fine.",
    "I wanted it ... but there was none. ¦ Hmm... my sister liked it. ¦ ...and the soup was cold…",
    "Loved the soup! 😀 ¦ They have more 🍜 for us! 🎉🎉 ¦ Good.",
    "he answered, “we have no curry.” ¦ the table shook. ¦ “never again!” said bob. ¦ it was 1955. ¦ bread, etc. and more. ¦ come again. ¦ fine",
    "Am 3. Mai zahlte Hr. Wolf ca. 49,50 Euro, d. h. zu viel. ¦ „Nie wieder!“, rief Fr. Voss. ¦ Im 2. Stock gab es z. B. Brot usw. und Suppe. ¦ Das Lokal in der Langstr. öffnet um 9.30 Uhr. ¦ Gut.",
    "Qui refuserait ? ¦ « Plus jamais ! » a crié Mme Roy. ¦ M. Roy a payé env. 23,50 euros, cf. p. 31 du guide. ¦ Du pain, etc. puis... la soupe.",
    "El Sr. Paz pagó aprox. 26,50 euros. ¦ «¡Nunca más!», gritó la Sra. Paz. ¦ Cierran a las 10 p. m. según Paz. ¦ ¿Quién no? ¦ ¡Qué rica!",
    "«Никогда!» — сказал он. ¦ Г. Орлов заплатил ок. 7,50 руб. за борщ на ул. Мира, д. 16, корп. 2. ¦ Взяли хлеб, сыр и т. д. и пирог. ¦ Вкусно.",
    "Ο κ. Ρήγας πλήρωσε περ. 15,50 ευρώ. ¦ Ποιος δεν θα γύριζε; ¦ Ανοίγει στις 9.30 π.μ. κάθε μέρα.",
    "यह अच्छा है। ¦ डॉ. राम ने 22.50 रुपये दिए। ¦ “फिर कभी नहीं!” बहन ने कहा। ¦ क्या आप लौटेंगे?",
    "دفع د. سامي نحو 9.50 دينار. ¦ من لا يعود؟ ¦ قالت أختي «لن أعود أبدا!» عند الباب.",
    "다시 가요. ¦ “다시는 안 와요.”라고 친구가 말했어요. ¦ 42.5점이에요.",
    "ร้านเปิดเวลา 11.30 ทุกวัน ¦ น้องสาวบอกว่าอร่อย ¦ ราคา 45 บาท",
]
CASES_WITHOUT_SPACES = [
    "「もう来ません。」と友人は言いました。¦店主は「売り切れ！」と叫びました。¦これは…やはり薄いです。",
    "“再也不来了。”朋友说。¦老板说：“最后一份了！”¦下雨天去。¦那里……还是那么好吗？！¦评分是4.5分。",
    "They closed early.¦Five of us left.",
]


def parts(text):
    return [text[a:b] for a, b in sentences_of(text)]


@pytest.mark.parametrize("case", CASES)
def test_cases(case):
    want = case.split(" ¦ ")
    assert parts(" ".join(want)) == want
    assert [" ".join(p.split()) for p in parts("\n".join(want) + "\n")] == [" ".join(w.split()) for w in want]


@pytest.mark.parametrize("case", CASES_WITHOUT_SPACES)
def test_without_spaces(case):
    assert parts(case.replace("¦", "")) == case.split("¦")


def test_layout():
    text = "Owner reply\n\nA first one\nthat goes on. A second\r\n\r\nBefore you go:\n1. Ask for p.m. Now\n2. Dogs welcome\n\n- a. B\n- c\n\nOn May\n3. It went on"
    assert parts(text) == ["Owner reply", "A first one\nthat goes on.", "A second", "Before you go:", "1. Ask for p.m. Now", "2. Dogs welcome", "- a. B", "- c", "On May\n3.", "It went on"]
    assert parts(None) == parts("") == parts(" \n　") == []


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab A.!?…\n\"“”(«»)' 1;。、ก😀​ -*", max_size=60))
def test_sentences_cover_all_but_white_space(text):
    spans = sentences_of(text)
    covered = set()
    for a, b in spans:
        assert 0 <= a < b <= len(text) and not text[a].isspace() and not text[b - 1].isspace()
        assert not covered & set(range(a, b))
        covered |= set(range(a, b))
    assert spans == sorted(spans)
    assert all(text[i].isspace() for i in range(len(text)) if i not in covered)


def test_long_texts_take_linear_time():
    text = "He said “no. Never. " + "It is 3.5 etc. and A. B. ok ... so. " * 4000
    assert len(sentences_of(text)) > 1000
    assert len(sentences_of("a" * 200_000)) == 1
    assert len(sentences_of("(" * 20_000 + ". " * 20_000)) >= 1


def test_operator(spark):
    df = spark.createDataFrame([(1, "One. Two.", 0), (2, None, 0), (3, " ", 0), (None, "A b.", 0), (1, "One. Two.", 0)], "doc_id long, text string, start_char int")
    rows = sorted(sentences(df).collect(), key=str)
    assert rows == sorted([(1, 0, 4), (1, 5, 9), (1, 0, 4), (1, 5, 9), (None, 0, 4)], key=str)
    assert sentences(df.limit(0)).collect() == []


@pytest.mark.parametrize("words", [25, 40, 150])
def test_bracket_of_any_length_on_its_own_is_a_sentence(words):
    parts = ["We went there.", "(" + "some words about it " * words + "too.)", "The food was good."]
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentences_of(text)] == parts
    # Inside a sentence it does not end it, however long.
    inside = ["We went there " + parts[1] + " on Sunday.", "The food was good."]
    text = " ".join(inside)
    assert [text[a:b] for a, b in sentences_of(text)] == inside


@pytest.mark.parametrize("text", ["Nice! :)", "Food was really great! :)", "Food was really great here on Sunday! The staff was friendly too! :)"])
def test_wordless_rest_stays_with_its_sentence_at_any_length(text):
    assert sentences_of(text)[-1][1] == len(text)
    assert all(any(c.isalnum() for c in text[a:b]) for a, b in sentences_of(text))


def test_no_bound_on_nesting_or_on_the_length_of_a_run():
    deep = "He went " + "(" * 45 + "a. B" + ")" * 45 + " home."
    assert parts(f"{deep} Next.") == [deep, "Next."]
    for letters in (10, 60, 1000):
        address = "See https://example.com/" + "a" * letters + ".Html for it."
        assert parts(f"{address} Next one.") == [address, "Next one."]


@pytest.mark.parametrize("text", ["a." * 20_000, "(" * 20_000 + "]" * 20_000, "(.(. " * 5_000, "x.((((" * 5_000, "“a. ”" * 5_000])
def test_runs_of_marks_take_linear_time(text):
    assert sentences_of(text)[-1][1] == len(text.rstrip())


def test_the_search_weighs_what_no_candidate_tells():
    """Marks within a quotation are candidates of positive score; only the balance of the spans keeps them from ending a sentence."""
    text = "He answered, “We have none. Come again! Please.” and left. Fine."
    block = _Block(text)
    assert sum(not isinstance(x, tuple) and x > 0 for x in block.scores) > 2 and any(block.split)
    assert parts(text) == ["He answered, “We have none. Come again! Please.” and left.", "Fine."]
