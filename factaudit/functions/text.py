"""Named text normalisers and text measures as column expressions.

Each normaliser has its own rules and they are not interchangeable.  All are built-in expressions but for
NFKC and full case folding, which need Unicode tables that Spark lacks: texts beyond ASCII are folded by a
vectorised function, once per distinct value of a batch.
"""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ASCII = r"^[\x00-\x7F]*$"
#: White space that the regular expressions' own class leaves out.
_SPACE = r"[\s\x0b\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


@F.pandas_udf(T.StringType())
def _fold(values: pd.Series) -> pd.Series:
    forms = {v: unicodedata.normalize("NFKC", v).casefold() for v in values.dropna().unique()}
    return values.map(lambda v: forms.get(v))


def folded(text: Column) -> Column:
    """NFKC and full case folding; ASCII texts, which are most, stay in built-in expressions."""
    plain = text.rlike(_ASCII)
    return F.when(plain, F.lower(text)).otherwise(_fold(F.when(~plain, text)))


def collapse(text: Column) -> Column:
    """Runs of white space become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def normalize_text(text: Column, fold=folded) -> Column:
    """NFKC, case folding and collapsed white space; null becomes empty."""
    return F.coalesce(collapse(fold(text)), F.lit(""))


def normalize_lexical(text: Column, fold=folded) -> Column:
    """Letter and digit tokens after NFKC and case folding, joined by one space.

    ``fold`` is ``F.lower`` where the text is an element of an array, which Python cannot reach.
    """
    return F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", " "))


def normalize_match_text(text: Column, fold=folded) -> Column:
    """As the lexical form, but an underscore is part of a word."""
    return F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{N}_]+", " "))


def alnum_key(text: Column, fold=folded) -> Column:
    """Letters and digits only, after NFKC and case folding."""
    return F.regexp_replace(fold(text), r"[^\p{L}\p{N}]", "")


def comparable_text(text: Column) -> Column:
    """ASCII letters and digits after a leading article is dropped; other scripts compare as empty."""
    return F.regexp_replace(F.regexp_replace(normalize_text(text), r"^(a|an|the)\s+", ""), r"[^a-z0-9]+", "")


def clean_text(text: Column) -> Column:
    """Collapsed text, null where nothing is left."""
    return F.nullif(collapse(text), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def tokens(text: Column) -> Column:
    """The distinct tokens of a lexical form."""
    return F.array_distinct(F.filter(F.split(normalize_lexical(text, F.lower), " "), lambda t: t != ""))


def char_ngrams(text: Column, size: int = 3) -> Column:
    """Distinct character n-grams of a text padded with size - 1 spaces on both sides."""
    padded = F.concat(F.lit(" " * (size - 1)), text, F.lit(" " * (size - 1)))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - F.lit(size - 1))), lambda i: F.substring(padded, i, F.lit(size)))
    return F.array_distinct(F.when(F.length(text) > 0, grams).otherwise(F.array().cast("array<string>")))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all items of two sets; two empty sets are 0."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.round(F.size(F.array_intersect(a, b)) / both, 6))


def containment(a: Column, b: Column) -> Column:
    """Shared items over the smaller set."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.round(F.size(F.array_intersect(a, b)) / least, 6))


def length_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.round(F.least(F.length(a), F.length(b)) / longest, 6))


def word_count(text: Column) -> Column:
    return F.when(F.trim(text) == "", F.lit(0)).otherwise(F.size(F.split(collapse(text), " ")))


def nonspace_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\s", ""))


def literal_pattern(text: Column) -> Column:
    """The text as a regular expression that matches itself."""
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")


def reply_json(text: Column) -> Column:
    """The JSON object in a model's reply: inside a fence, else from the first to the last brace."""
    unfenced = F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", "")
    return F.nullif(F.regexp_extract(unfenced, r"(?s)(\{.*\})", 1), F.lit(""))


def url_key(url: Column) -> Column:
    """Endpoint in one form: lower case, without scheme, default port, query and closing slash."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^https?://", "")
    return F.regexp_replace(F.regexp_replace(bare, r":(80|443)(/|$)", "$2"), r"[?#].*$|/+$", "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9._-]+", "_"), r"^_+|_+$", "")


@F.pandas_udf(T.StringType())
def casefold_exact(values: pd.Series) -> pd.Series:
    """Full case folding and collapsed white space without NFKC."""
    forms = {v: " ".join(v.casefold().split()) for v in values.dropna().unique()}
    return values.map(lambda v: forms.get(v, ""))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching runs of two texts, as the standard library's matcher counts them."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")
