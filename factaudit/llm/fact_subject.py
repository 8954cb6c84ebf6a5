"""The subject of a canonical fact, read from its normalised wording by SQL expressions.

A fact names its subject in one of a few shapes ("the R of S is V", "V is the R of S", "for S the R is
given as V", "S has V as its R").  The value is taken out first where its wording is known, so that a
value that looks like a name or holds the words of a shape is not mistaken for the subject.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The kinds of things described, which may stand before a subject's name.
KINDS = "town|river|museum|company|film|mineral|species"

_NAME = rf"(?:the )*(?:(?:{KINDS}) )?(\w+ \w+)"
_TAIL = r"(?: (?:in|according to|per|as per) (?:the )*(?:\d{4}|vvalue) \w+)?"
_SHAPES = (
    rf"(?:^| )for {_NAME} (?:the )*[a-z0-9 ]+? (?:is )+\w+ as ",
    rf"(?:^| ){_NAME} has .* as its ",
    rf"^.* (?:is )+(?:the )*[a-z0-9 ]+ (?:of )+{_NAME}{_TAIL}$",
    rf"^[a-z0-9 ]+ (?:of )+{_NAME} (?:is )+",
)


def plain_words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def subject_of(fact: Column, answer: Column) -> Column:
    """The subject in lower case, or null where the fact is null or has no known shape."""
    words = plain_words(fact)
    value = F.coalesce(plain_words(answer), F.lit(""))
    # Spaces on both sides, so that a value is replaced as whole words only.
    padded = F.concat(F.lit(" "), words, F.lit(" "))
    bare = F.when(value == "", words).otherwise(
        F.trim(F.replace(padded, F.concat(F.lit(" "), value, F.lit(" ")), F.lit(" vvalue "))))
    # As the element of an array the text is worked out once for all shapes.
    named = F.transform(F.array(bare), lambda b: F.coalesce(*[F.nullif(F.regexp_extract(b, shape, 1), F.lit("")) for shape in _SHAPES]))
    return F.get(named, 0)
