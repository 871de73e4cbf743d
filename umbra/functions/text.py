"""Scalar functions on text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{Nd}]", "")


def within_one_edit(a: Column, b: Column) -> Column:
    """At most one inserted, deleted, replaced or swapped neighbouring character, ignoring case."""
    a, b = F.lower(a), F.lower(b)
    n = F.char_length(a)
    swaps = F.when(n >= 2, F.exists(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.substring(a, 1, 0), a.substr(F.lit(1), i - 1), a.substr(i + 1, F.lit(1)), a.substr(i, F.lit(1)), a.substr(i + 2, n)) == b)).otherwise(False)
    near = F.levenshtein(a, b) <= 1
    return near | ((n == F.char_length(b)) & (F.levenshtein(a, b) == 2) & swaps)


def label_key(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, r"[^\p{L}]", ""))


def term_pattern(term: str) -> str:
    """A user's term as a pattern: any white space between words, no alphanumeric neighbour at an alphanumeric edge."""
    words = term.split()
    body = r"\s+".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in words)
    head = r"(?<![A-Za-z0-9])" if words and words[0][0].isalnum() else ""
    tail = r"(?![A-Za-z0-9])" if words and words[-1][-1].isalnum() else ""
    return f"(?i){head}{body}{tail}"


# Endings that make a dotted token a file name or a domain.
EXTENSIONS = frozenset("pdf doc docx xls xlsx ppt pptx txt csv jpg jpeg png gif bmp tif tiff mp3 mp4 mov wav m4a avi zip exe dll htm html xml json js css".split())
DOMAINS = frozenset("com net org gov edu us io co uk ca me tv info biz".split())


def _measure(token: str) -> bool:
    """An ordinal, a number with its unit, or a version: digits with a few letters at one end, or only digits and stops."""
    low = token.lower()
    digits = low.rstrip("abcdefghijklmnopqrstuvwxyz")
    letters = len(low) - len(digits)
    if letters <= 3 and digits.replace(".", "", 1).isdecimal() and digits[0] != ".":
        return True
    return "." in low and all(p.isdecimal() for p in low.removeprefix("v").split("."))


def handle_like(token: str) -> bool:
    """The shape of a user name, and not of a date, id, unit, version, file name or domain."""
    v = token.rstrip(".")
    head, _, rest = v.partition(".")
    digit, underscore = any(c.isdecimal() for c in v), "_" in v
    dotted = len(head) >= 2 and head.isascii() and head.isalnum() and len(rest) >= 2 and rest[-2:].isalnum()
    if not 5 <= len(v) <= 40 or not any(c.islower() for c in v) or not (digit or underscore or dotted):
        return False
    if not digit and (not dotted and "_" not in v.strip("_") if underscore else any(c.isupper() for c in rest)):
        return False
    return not _measure(v) and v.rpartition(".")[2].lower() not in (EXTENSIONS | DOMAINS if "." in v else ())
