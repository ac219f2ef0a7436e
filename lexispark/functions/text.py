"""Scalar text functions, as column expressions inside whole-stage code.

Only Unicode decomposition and Beta Code have no built-in counterpart; both are
Arrow functions meant for distinct strings.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.schemas import FEATURES, LANGUAGE_CODES

DIACRITIC_MARKS = "()\\/*=|+'"
# Codes of the lexica whose meanings get another tag than i.
MEANING_TAGS = {"1999.04.0057": "g", "1999.04.0058": "g", "1999.04.0072": "g", "1999.04.0073": "g", "1999.04.0059": "l", "1999.04.0060": "l"}
DETAIL_ORDER = ("grammatical_case", "number", "gender", "tense", "mood", "voice", "person", "degree", "dialect", "other")


def lookup(c: Column, values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[c]


def bare_form(c: Column) -> Column:
    return F.translate(c, DIACRITIC_MARKS, "")


def uncapitalize(c: Column) -> Column:
    """The first letter in lower case, whatever stands before it."""
    pattern = r"(?s)^(\P{L}*)(\p{Lu})(.*)$"
    part = lambda k: F.regexp_extract(c, pattern, k)
    return F.when(c.rlike(pattern), F.concat(part(1), F.lower(part(2)), part(3))).otherwise(c)


def _one_capital(letter: str) -> str:
    """A letter's capital, if it is one letter: there is one of ß, but its usual one is two."""
    found = next((x for x in (letter.upper(), letter.title()) if len(x) == 1), letter)
    return "ẞ" if letter == "ß" else found


_CAPITALS = {x: _one_capital(x) for x in map(chr, range(128, sys.maxunicode + 1)) if len(x.upper()) > 1 or x.upper() != x}
_CAPITALS = {x: y for x, y in _CAPITALS.items() if x != y} | {chr(k): chr(k - 32) for k in range(97, 123)}


def upper_letters(c: Column) -> Column:
    """Upper case letter by letter: every letter stays one (upper() makes SS of ß), and what has no such capital stays as it is."""
    return F.translate(c, "".join(_CAPITALS), "".join(_CAPITALS.values()))


def load_form(language: Column, c: Column) -> Column:
    """A record's form in lower case (Arabic has none; Greek only its first letter, and no capital sign)."""
    return F.when(match_case(language), c).when(language == "grc", F.translate(uncapitalize(c), "*", "")).otherwise(F.lower(c))


def query_form(language: Column, c: Column) -> Column:
    """A searched word in lower case: as load_form, but Greek looks at the first character only."""
    first = F.substring(c, 1, 1)
    greek = F.translate(F.when(first.rlike(r"^\p{Lu}$"), F.concat(F.lower(first), F.substring(c, 2, 1 << 30))).otherwise(c), "*", "")
    return F.when(match_case(language), c).when(language == "grc", greek).otherwise(F.lower(c))


def match_case(language: Column) -> Column:
    return language == "ara"


def canonical_language(c: Column) -> Column:
    return F.coalesce(lookup(c, LANGUAGE_CODES), c)


def stripped(s: str | None) -> str | None:
    """Lower case without combining marks."""
    if s is None:
        return None
    return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c)[0] != "M").lower()


@F.arrow_udf(T.StringType())
def _normalize(words: pa.Array) -> pa.Array:
    return pa.array([stripped(x) for x in words.to_pylist()], pa.string())


def normalize_unicode(c: Column) -> Column:
    """Decomposed, without marks, in lower case."""
    return _normalize(c)


def lemma_parts(c: Column) -> Column:
    """Struct of headword and sequence number (-1 if none) of a lemma's text."""
    text = F.translate(c, "#", "")
    text = F.when(text.rlike(r"^.+-(.+)$"), F.regexp_extract(text, r"^.+-(.+)$", 1)).otherwise(text)
    numbered = r"^(\D+)(\d+)$"
    has = text.rlike(numbered)
    return F.struct(
        F.when(has, F.regexp_extract(text, numbered, 1)).otherwise(text).alias("headword"),
        F.when(has, F.regexp_extract(text, numbered, 2).cast("int")).otherwise(F.lit(-1)).alias("sequence_number"),
    )


def fold_key(*features: Column) -> Column:
    return F.concat_ws("", *(features or (F.col(c) for c in FEATURES)))


def sense_ids(c: Column) -> Column:
    """Struct of entry and sense id of an id like n12.34a, else -1 and -1."""
    pattern = r"^n(\d+[a-zA-Z]*)\.(\d+[a-zA-Z]*)$"
    ok = F.coalesce(c.rlike(pattern), F.lit(False))
    return F.struct(*(F.when(ok, F.regexp_extract(c, pattern, k)).otherwise("-1").alias(n) for k, n in ((1, "entry_id"), (2, "sense_id"))))


def meaning_tag(c: Column) -> Column:
    return F.coalesce(lookup(F.regexp_extract(c, r"^\w+:text:(.+)$", 1), MEANING_TAGS), F.lit("i"))


def stored_level(c: Column) -> Column:
    """A level attribute as stored: -1 if missing; other text than a number fails."""
    return F.coalesce(c.cast("int"), F.lit(-1))


def shown_level(c: Column) -> Column:
    return F.nullif(c, F.lit(-1))


def lexicon_key(headword: Column, sequence_number: Column) -> Column:
    return F.concat(headword, F.when(sequence_number != -1, sequence_number.cast("string")).otherwise(""))


def morph_details() -> Column:
    """The features shown for a parse, joined by middle dots."""
    return F.concat_ws(" · ", *(F.nullif(F.col(c), F.lit("")) for c in DETAIL_ORDER))


# Beta Code letters and marks.
BETA_LETTERS = dict(zip("abgdezhqiklmncoprstufxyw", "αβγδεζηθικλμνξοπρστυφχψω", strict=True)) | {"v": "ϝ"}
BETA_MARKS = {")": "̓", "(": "̔", "/": "́", "\\": "̀", "=": "͂", "+": "̈", "|": "ͅ"}
BETA_SIGNS = {":": "·", "'": "’", "_": "—"}


def beta_to_greek(s: str | None) -> str | None:
    """Beta Code as composed Greek; text that is Greek already stays as it is."""
    if s is None or re.search(r"[Ͱ-Ͽἀ-῿]", s):
        return s
    out, k = [], 0
    while k < len(s):
        c, marks, upper = s[k], "", False
        k += 1
        if c == "*":
            upper = True
            while k < len(s) and s[k] in BETA_MARKS:
                marks += s[k]
                k += 1
            if k == len(s):
                out += ["*", marks]
                break
            c = s[k]
            k += 1
        letter = BETA_LETTERS.get(c.lower())
        if letter is None:
            out.append(("*" + marks if upper else "") + BETA_SIGNS.get(c, c))
            continue
        if c.lower() == "s" and k < len(s) and s[k] in "123":
            letter = {"1": "σ", "2": "ς", "3": "ϲ"}[s[k]]
            k += 1
        elif c.lower() == "s" and not upper and (k == len(s) or not (s[k].isalpha() or s[k] in "*'")):
            letter = "ς"
        while k < len(s) and s[k] in BETA_MARKS:
            marks += s[k]
            k += 1
        out.append((letter.upper() if upper else letter) + "".join(BETA_MARKS[m] for m in marks))
    return unicodedata.normalize("NFC", "".join(out))


@F.arrow_udf(T.StringType())
def _beta(words: pa.Array) -> pa.Array:
    return pa.array([beta_to_greek(x) for x in words.to_pylist()], pa.string())


def beta_code_to_greek(c: Column) -> Column:
    return _beta(c)
