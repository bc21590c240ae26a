"""Tokens and words in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters deleted from words in word counts (fixed value).
PUNCTUATION = "([,.!?:;])"
#: Characters deleted from words in profiles (fixed value).
PUNCTUATION_AND_DIGITS = "([,.!?:;])01\"23456789-\\&"
#: White space between words (fixed value).
SPACE = "[\\s\\u001c-\\u001f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def single_space_tokens(text: Column) -> Column:
    """Lower-case tokens between single spaces, without empty ones. Null for null."""
    return F.filter(F.split(F.lower(text), " ", -1), lambda t: t != "")


def whitespace_tokens(text: Column) -> Column:
    """Lower-case tokens between runs of white space, without empty ones. Null for null."""
    return F.filter(F.split(F.lower(text), SPACE, -1), lambda t: t != "")


def clean_word(token: Column, deleted: str = PUNCTUATION) -> Column:
    """The token without the deleted characters; it may be empty."""
    return F.translate(token, deleted, "")
