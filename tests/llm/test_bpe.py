import base64
import functools
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oremill.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.isdir(bpe.FOLDER), reason="no vocabulary files")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks()


@pytest.fixture(scope="module")
def reference(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "\n\n  \t", "Hello world's", "<|endoftext|>", "ครัวของวูกนีสิมีคานทำแกงปลา" * 5, "湖鹭玉阁帆海" * 20, "a" * 3000, "naïve café 👩‍🍳 ½ №5", "x" + " " * 50 + "y", "\u0000﻿"]


def test_same_ids_as_an_independent_encoder(ranks, reference):
    encoder = bpe.Encoder(ranks)
    for text in TEXTS:
        assert encoder.encode(text) == reference.encode_ordinary(text), text[:20]


@functools.cache
def cached_ranks():
    return bpe.read_ranks()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_random_texts(text):
    ranks = cached_ranks()
    ids = bpe.Encoder(ranks).encode(text)
    tokens = {i: t for t, i in ranks.items() if i in set(ids)}
    assert bpe.decode(ids, tokens) == text


def test_merge_order_against_rescanning(ranks):
    def slow(piece):
        parts = [bytes([b]) for b in piece]
        while True:
            best = min(((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 30, 0))
            if best[0] == 1 << 30:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    for text in ("unbelievableness", "aaaaaaaaaaaab", "ครัวของวูกนี", "zzzzqqqqxxxx", "internationalisation"):
        assert bpe.merge(text.encode(), ranks) == slow(text.encode())


def test_table_is_emptied(ranks, reference):
    encoder = bpe.Encoder(ranks, most=3)
    assert encoder.encode("one two three four five") == reference.encode_ordinary("one two three four five")
    assert len(encoder.known) <= 3


def test_operator(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate([*TEXTS, None])] + [(3, TEXTS[3], 0), (None, "a", 0)], "doc_id long, text string, ids int")
    rows = bpe.encoded(df).collect()
    assert len(rows) == len(TEXTS) + 3
    by = {r.doc_id: list(r.ids) for r in rows}
    assert by[0] == [] and by[len(TEXTS)] == [] and by[1] == [220] and by[None] == [64]
    assert bpe.encoded(df.limit(0)).collect() == []


def test_ranks_file_format(tmp_path):
    (tmp_path / "v.tiktoken").write_bytes(base64.b64encode(b"a") + b" 0\n" + base64.b64encode(b"b") + b" 1\n\n")
    assert bpe.read_ranks(str(tmp_path), "v") == {b"a": 0, b"b": 1}
