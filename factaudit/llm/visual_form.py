"""Bringing text that looks the same to one form, and finding text written with other characters.

The work has two steps.  The plain form brings every variant character to the ordinary one in its place and
leaves ordinary text as it is: invisible characters go, special spaces become spaces, compatibility forms
are composed (NFKC), look-alike letters become Latin inside words of the Latin alphabet and in words wholly
of look-alikes that imitate a word of their context.  Punctuation that is ordinary in Chinese text stays.
The canonical form is the plain form in NFKC with full case folding and single spaces.  A value is written
with other characters where its plain form differs from it.

The work is done once per distinct value of an Arrow batch, so hot values cost little and nothing is
shuffled.

Defined results: null stays null and is never reported; an empty text stays empty; a text of
ignorable characters only becomes empty; values are taken whole, whatever their length.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of the Cyrillic and Greek alphabets that look like Latin letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v", "ү": "y",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ӏ": "I", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "υ": "u", "ι": "i", "κ": "k", "γ": "y", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g",
}

# Wide punctuation that is ordinary in Chinese text, and the ellipsis.
CHINESE_PUNCTUATION = "！（），：；？～％＋－＝／＆＃＊＠．…‥￥"

#: Characters that are invisible by default (Unicode Default_Ignorable_Code_Point), as ranges.
IGNORABLE = re.compile(
    "[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯"
    "ㅤ︀-️﻿ﾠ￰-￸\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]"
)
#: Joiners and selectors inside a sequence of pictographs belong to the picture.
PICTURE_JOINT = re.compile("(?<=[←-⯿\U0001f000-\U0001faff️])[‍️](?=$|[^\\w])|(?<=[‍])[️]|(?<=️)‍(?=[←-⯿\U0001f000-\U0001faff])|(?<=[\U0001f000-\U0001faff←-⯿])‍(?=[←-⯿\U0001f000-\U0001faff])")
ODD_SPACE = re.compile("[   -     　\u0085\u000b\u000c\u001c-\u001f]")
HAN = re.compile("[㐀-鿿\U00020000-\U0003ffff]")
RADICAL = re.compile("[⺀-⻿]")
OTHER_LETTER = re.compile("[Ͱ-֏Ꭰ-Ᏽꭰ-ꮿ\u0131\u0251\u0261]")
#: Splits a text at what stays as it is (odd parts of the result).
ORDINARY_IN_CHINESE = re.compile(f"([{re.escape(CHINESE_PUNCTUATION)}]+)")
ELLIPSIS = re.compile("(…+)")
DETACHED = re.compile("[\u0300-\u036f]")
CODE_OR_WORD = re.compile(r"[^\W_]+")


def _alphabet(ch: str) -> str:
    """latin, other (Greek, Cyrillic, Armenian) or none."""
    if ch < "ɐ":
        return "latin" if ch.isalpha() else "none"
    name = unicodedata.name(ch, "")
    if name.startswith(("LATIN", "FULLWIDTH LATIN")):
        return "latin"
    return "other" if name.startswith(("GREEK", "CYRILLIC", "ARMENIAN", "CHEROKEE")) else "none"


def _to_latin(word: str) -> str | None:
    """The word with every look-alike replaced, or None where a letter has no Latin double."""
    out = []
    for ch in word:
        if _alphabet(ch) == "other":
            if ch not in LOOKALIKES:
                return None
            ch = LOOKALIKES[ch]
        out.append(ch)
    return "".join(out)


def _bare(text: str) -> str:
    """Case-folded letters and digits without accents, to compare words by their look."""
    return "".join(c for c in unicodedata.normalize("NFKD", text).casefold() if not unicodedata.combining(c))


def _imitated(word: str) -> str | None:
    """The Latin look of a word wholly of another alphabet, or None where it has none."""
    kinds = {_alphabet(c) for c in word}
    if "other" not in kinds or "latin" in kinds or (len(word) == 1 and word in "αβγδεικνορυμπσω"):
        return None
    return _to_latin(word)


def _visible(text: str) -> str:
    return unicodedata.normalize("NFKC", IGNORABLE.sub("", text))


def _context_words(context: str | None) -> set[str]:
    """The words of a context by their look, as written and without what is invisible."""
    return {_bare(m.group()) for t in (context or "", _visible(context or "")) for m in CODE_OR_WORD.finditer(t)}


def plain_form(text: str | None, context: str | None = None) -> str | None:
    """The text with ordinary characters in place of variants; ``context`` tells which Latin words it may imitate."""
    if text is None or text == "":
        return text
    if text.isascii():
        return ODD_SPACE.sub(" ", text)
    # Joiners and selectors inside a picture belong to it.
    kept = PICTURE_JOINT.findall(text)
    text = PICTURE_JOINT.sub("\ue000", text) if kept else text
    text = ODD_SPACE.sub(" ", IGNORABLE.sub("", text))
    stays = ORDINARY_IN_CHINESE if HAN.search(unicodedata.normalize("NFKC", text)) else ELLIPSIS
    text = "".join(part if i % 2 else unicodedata.normalize("NFKC", part) for i, part in enumerate(stays.split(text)))
    # An accent that composes with no letter is detached for good.
    text = DETACHED.sub("", text)
    known: set[str] | None = None

    def word(m: re.Match) -> str:
        kinds = {_alphabet(c) for c in m.group()}
        if "other" in kinds and "latin" in kinds:
            return _to_latin(m.group()) or m.group()
        if context and (latin := _imitated(m.group())):
            nonlocal known
            known = _context_words(context) if known is None else known
            return latin if _bare(latin) in known else m.group()
        return m.group()

    if OTHER_LETTER.search(text):
        text = CODE_OR_WORD.sub(word, text)
    for joint in kept:
        text = text.replace("\ue000", joint, 1)
    return text


def canonical_form(text: str | None, context: str | None = None) -> str | None:
    """One consistent form of a text (see the module)."""
    if text is None:
        return None
    text = unicodedata.normalize("NFKC", IGNORABLE.sub("", plain_form(text, context)))
    return unicodedata.normalize("NFKC", IGNORABLE.sub("", " ".join(text.split()).casefold()))


def has_variant_characters(text: str | None, context: str | None = None) -> bool:
    """Whether a text holds a character that is invisible or stands for another."""
    return text is not None and plain_form(text, context) != text


class _Forms(dict):
    """Forms by value, worked out once; values with letters of other alphabets by value and context."""

    def __init__(self, form):
        super().__init__()
        self.form = form

    def of(self, value: str | None, context: str | None) -> str | None:
        if value is None:
            return None
        at = (value, context) if OTHER_LETTER.search(value) or OTHER_LETTER.search(_visible(value)) else value
        if at not in self:
            self[at] = self.form(value, context)
        return self[at]


def _each(form, values: pd.Series, context: pd.Series) -> pd.Series:
    forms = _Forms(form)
    return pd.Series([None if a is None else [forms.of(v, c) for v in a] for a, c in zip(values, context)], dtype="object")


@F.pandas_udf(T.ArrayType(T.StringType()))
def plain_values(values: pd.Series, context: pd.Series) -> pd.Series:
    """The plain form of each value of an array."""
    return _each(plain_form, values, context)


@F.pandas_udf(T.ArrayType(T.StringType()))
def canonical_array(values: pd.Series, context: pd.Series) -> pd.Series:
    """The canonical form of each value of an array."""
    return _each(canonical_form, values, context)


def looks_alike(values: Column, context: Column) -> Column:
    """True where a value of the array ``values`` is written with other characters than its plain form."""
    return ~values.eqNullSafe(plain_values(values, context))


def canonical_values(rows: DataFrame, column: str, into: str, context: str | None = None) -> DataFrame:
    """``rows`` with the canonical form of a string column (arrays: element by element, in order).

    Words wholly of look-alikes are brought to Latin where the ``context`` column has the word they imitate.
    """
    said = F.lit(None).cast("string") if context is None else rows[context]
    if isinstance(rows.schema[column].dataType, T.ArrayType):
        return rows.withColumn(into, canonical_array(rows[column], said))
    return rows.withColumn(into, F.get(canonical_array(F.array(rows[column]), said), 0))
