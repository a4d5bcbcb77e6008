"""Fuzzy text normal form and containment tests."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import let

SHINGLE_WORDS = 4
MIN_FUZZY_CHARS = 8
MIN_TOKEN_CHARS = 4
TOKEN_SHARE = 0.55


def _nfkd(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def decompose(c: Column) -> Column:
    """Unicode compatibility decomposition. Spark has none, so text beyond ASCII, and only that, visits Python."""
    nfkd = F.pandas_udf(_nfkd, "string")
    return F.coalesce(nfkd(F.when(F.rlike(c, F.lit(r"[^\x00-\x7F]")), c)), c)


def fold_decomposed(c: Column) -> Column:
    """Normal form of already decomposed text: no accents, no odd characters (quotes are), one blank, lower case.

    Odd characters and white space both end as one blank, so one replacement serves both.
    """
    bare = F.regexp_replace(c, r"[\x{0300}-\x{036F}]+", "")
    return F.lower(F.btrim(F.regexp_replace(bare, r"[^\w.,;:!?()/-]+", " ")))


def fold(c: Column) -> Column:
    return fold_decomposed(decompose(F.coalesce(c, F.lit(""))))


def fold_text(text: str | None) -> str:
    """What `fold` makes of a text, for work that is in Python anyway."""
    text = text or ""
    if not text.isascii():
        text = re.sub("[\u0300-\u036f]+", "", unicodedata.normalize("NFKD", text))
    return re.sub(r"[^\w.,;:!?()/-]+", " ", text, flags=re.ASCII).strip(" ").lower()


def split_words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: F.length(w) > 0)


def shingles(words: Column, n: int = SHINGLE_WORDS) -> Column:
    """Distinct word n-grams; none for fewer words."""

    def grams(ws: Column) -> Column:
        last = F.size(ws) - n + 1
        cut = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: F.array_join(F.slice(ws, k, F.lit(n)), " "))
        return F.when(last >= 1, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))

    return let(words, grams)


def fuzzy_contains(hay: Column, needle: Column) -> Column:
    """Both sides already folded: contained, or at least 55 % of the needle's longer words are."""

    def partly(tokens: Column) -> Column:
        hits = F.size(F.filter(tokens, lambda t: F.contains(hay, t)))
        lead = F.substring(needle, F.lit(1), F.greatest(F.lit(6), F.floor(F.length(needle) * F.lit(0.7)).cast("int")))
        return F.when(F.size(tokens) == 0, F.contains(hay, lead)).otherwise(hits / F.size(tokens) >= TOKEN_SHARE)

    long_words = F.filter(F.split(needle, " "), lambda w: F.length(w) >= MIN_TOKEN_CHARS)
    return (
        F.when((F.length(hay) == 0) | (F.length(needle) == 0), False)
        .when(F.contains(hay, needle), True)
        .when(F.length(needle) < MIN_FUZZY_CHARS, False)
        .otherwise(let(long_words, partly))
    )
