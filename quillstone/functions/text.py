"""Text as columns: whatever Spark's own functions express stays in the JVM, the rest is an Arrow-batched pandas function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITE = r"(?U)\s+"


def compact(text: Column) -> Column:
    """White space of any kind becomes single spaces, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, WHITE, " "), "^ | $", "")


def unified_newlines(text: Column) -> Column:
    """Without a byte-order mark, with ``\\n`` for every line end."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Composed letters. Spark has no normalization function."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


#: Signs that no reader sees: zero-width ones, soft hyphens, byte-order marks, controls other than line ends and tabs (fixed values).
UNSEEN = r"[\x{200B}-\x{200F}\x{2060}-\x{2064}\x{00AD}\x{FEFF}\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}]"


@F.pandas_udf(T.StringType())
def _compatible(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def cleaned(text: Column) -> Column:
    """In compatibility composition (NFKC), with ``\\n`` for every line end, without unseen signs, a mark joined to the letter that a
    space tore it from, and no blanks at the ends of lines."""
    seen = F.regexp_replace(unified_newlines(text), UNSEEN, "")
    joined = F.regexp_replace(seen, r"(\p{L}) (\p{Mn})", "$1$2")
    return F.regexp_replace(_compatible(joined), r"(?m)[ \t]+$", "")


@F.pandas_udf(T.StringType())
def slug(text: pd.Series) -> pd.Series:
    """Lower-case ASCII letters and digits joined by hyphens; accents are dropped."""

    def one(t: str) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFKD", t.replace("đ", "d").replace("Đ", "D")) if not unicodedata.combining(c))
        return "-".join("".join(c.lower() if c.isascii() and c.isalnum() else " " for c in plain).split())

    return text.map(one, na_action="ignore")


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def distinct_tokens(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def or_query(text: Column) -> Column:
    """The distinct tokens of a question joined by ``|``; null where there are none."""
    return F.when(F.size(distinct_tokens(text)) > 0, F.array_join(distinct_tokens(text), " | "))


def question_key(text: Column) -> Column:
    """A question without case, punctuation and spacing, for finding repeats."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def excerpt(text: Column, size: int) -> Column:
    """At most ``size`` characters of the compacted text, cut at a word's end and marked by an ellipsis."""
    flat = compact(text)
    return F.when(F.length(flat) <= size, flat).otherwise(
        F.concat(F.regexp_replace(F.substring(flat, 1, size - 1), r"\s+\S*$", ""), F.lit("…")))


def citations(text: Column) -> Column:
    """Numbers of the passages cited as [E1], [E2], ... in order, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[E(\d+)\]"), 1), lambda n: n.cast("int")))


def upper_share(text: Column) -> Column:
    """Share of capitals among the letters; null without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) / letters)


def approximate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4)


def safe_name(text: Column) -> Column:
    """A file name: other characters than letters, digits, dot, dash and underscore become one underscore each run."""
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")

