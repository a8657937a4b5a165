"""Text expressions."""

from __future__ import annotations

import unicodedata
from math import isqrt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


def text_tokens(text: Column) -> Column:
    """ASCII words of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9']+)"))


def unicode_tokens(text: Column) -> Column:
    """Unicode words, apostrophes and hyphens included, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)([\w'-]+)"))


def normalized_match_text(text: Column) -> Column:
    return F.array_join(text_tokens(text), " ")


def token_jaccard(a: Column, b: Column) -> Column:
    """Share of common distinct tokens; 0 where either has none."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def token_overlap(a: Column, b: Column) -> Column:
    """Common tokens, repeats counted, over the shorter length; 0 where either has none."""
    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, t: s + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t))))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / F.least(F.size(a), F.size(b))).otherwise(F.lit(0.0))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_text(text: Column, limit: int) -> Column:
    """Collapsed white space, cut to ``limit`` characters with an ellipsis."""
    t = collapsed(text)
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("..."))).otherwise(t)


def ends_sentence(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "[\"'”’)\\]]+$", "").rlike("[.?!…]$")


def words_to_text(words: Column) -> Column:
    """Words joined by spaces, none before punctuation."""
    return F.regexp_replace(F.array_join(words, " "), r"\s+([,.;:!?])", r"$1")


def repeats_phrase(words: list[str], least_words: int) -> bool:
    """Whether a list is its first k words, k at least ``least_words``, twice or more."""
    n = len(words)
    divisors = {k for d in range(1, isqrt(n) + 1) if n % d == 0 for k in (d, n // d)}
    return any(least_words <= k < n and words[:k] == words[k : 2 * k] and words[k:] == words[:-k] for k in divisors)


def is_repeated_phrase(text: Column, least_words: int = 2) -> Column:
    """Whether the whole text is a phrase of at least so many words, twice or more. Texts of any length are judged whole.

    Words are runs of Unicode letters and digits of the text in form NFKC with cases folded.
    """

    def judge(texts: pd.Series) -> pd.Series:
        import regex

        word = regex.compile(r"[\p{L}\p{N}]+")
        return pd.Series([None if t is None else repeats_phrase(word.findall(unicodedata.normalize("NFKC", t).casefold()), least_words) for t in texts], dtype=object)

    return F.pandas_udf(judge, BooleanType())(text)


def contains_tokens(tokens: Column, phrase: Column) -> Column:
    """Whether the phrase's tokens follow one another in the text's."""
    return F.contains(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(phrase, " "), F.lit(" ")))


def video_id(url: Column) -> Column:
    """The id in a short, watch or embed address; null where there is none."""
    found = F.coalesce(
        F.nullif(F.regexp_extract(url, r"youtu\.be/([\w-]+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(url, r"[?&]v=([\w-]+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(url, r"/(?:embed|shorts|live)/([\w-]+)", 1), F.lit("")),
    )
    return found


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def label_index(label: Column) -> Column:
    """12 for S12, else null."""
    return F.nullif(F.regexp_extract(label, "^S([0-9]+)$", 1), F.lit("")).cast("int")


def due_hint(text: Column) -> Column:
    """A phrase that begins with by, until or bis, up to punctuation; null where there is none."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?i)\b(by|until|bis)\s+([^,.!?;]{2,40})", 0)), F.lit(""))
