"""Tokenisers and string functions as column expressions."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Runs between ASCII blanks, ASCII punctuation trimmed, ASCII lower case; those with a letter or digit."""
    parts = F.split(c, r"[ \t\n\f\r]+")
    trimmed = F.transform(parts, lambda w: ascii_lower(F.regexp_replace(w, r"^\p{Punct}+|\p{Punct}+$", "")))
    return F.filter(trimmed, lambda w: w.rlike(r"[\p{L}\p{N}]"))


def bigrams(c: Column) -> Column:
    """Adjacent words, joined by NUL."""
    w = words(c)
    return F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit("\0"), b))).otherwise(F.array().cast("array<string>"))


#: ASCII punctuation, and blanks that part words; ``bytes.split`` parts at one more.
_PUNCTUATION, _BLANKS, _OTHER_BLANK = string.punctuation.encode(), re.compile(rb"[ \t\n\f\r]+"), b"\x0b"
_LETTER_OR_DIGIT = re.compile(r"[^\W_]")


def words_of(text: bytes) -> list[bytes]:
    """``words`` of a text, in Python and UTF-8, whose bytes' lower case, blanks and punctuation are those of ASCII."""
    parts = text.lower().split() if _OTHER_BLANK not in text else _BLANKS.split(text.lower())
    return [w for w in [p.strip(_PUNCTUATION) for p in parts] if w.isalnum() or w and _LETTER_OR_DIGIT.search(w.decode())]


def bigrams_of(text: bytes) -> list[bytes]:
    """``bigrams`` of a text, in Python and UTF-8."""
    w = words_of(text)
    return [b"%b\0%b" % pair for pair in zip(w, w[1:])]


def ngrams(c: Column, n: int) -> Column:
    """Runs of ``n`` characters of each run of letters and digits, in full Unicode lower case; a shorter run is its own gram."""
    parts = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(parts, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: w.substr(i, F.lit(n))))
    return F.flatten(grams)


@F.pandas_udf(T.ArrayType(T.StringType()))
def code_words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Identifiers and their parts (at underscores, digits and changes of case), lower case, and symbols."""
    identifier = re.compile(r"[^\W\d]\w*|\d+|[^\w\s]")
    part = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\dA-Za-z_]+")

    def tokens(text: str | None) -> list[str] | None:
        if text is None:
            return None
        out = []
        for token in identifier.findall(text):
            parts = part.findall(token)
            out += [token.lower()] + ([p.lower() for p in parts] if len(parts) > 1 else [])
        return out

    for series in batches:
        yield series.map(tokens)


@F.pandas_udf(T.ArrayType(T.StringType()))
def graphemes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Extended grapheme clusters."""
    import regex

    clusters = regex.compile(r"\X").findall
    for series in batches:
        yield series.map(lambda t: None if t is None else clusters(t))


def before(c: Column, needle: str) -> Column:
    """What stands before the first ``needle``; empty if there is none."""
    at = F.instr(c, needle)
    return F.when(at > 0, c.substr(F.lit(1), at - 1)).otherwise("")


def after(c: Column, needle: str) -> Column:
    """What stands after the first ``needle``; empty if there is none."""
    at = F.instr(c, needle)
    return F.when(at > 0, c.substr(at + len(needle), F.length(c))).otherwise("")
