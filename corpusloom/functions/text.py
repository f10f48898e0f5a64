"""Scalar text expressions. All stay inside whole-stage code generation.

White space means the 29 code points of Python's ``str.split()``: Java's ``\\s``
knows only six of them, so every pattern here spells the class out. A null text
gives null everywhere; a text without words gives ``''`` or ``0``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: Python's white space, as a Java character class.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: The same class for RE2, as DuckDB needs it.
SPACE_RE2 = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column) -> Column:
    """Words joined by single spaces."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def norm_text(text: Column) -> Column:
    """Collapsed and lower-cased: what fingerprints and snippet search compare."""
    return F.lower(collapse(text))


def fingerprint(text: Column) -> Column:
    """16 hex digits of the SHA-256 of the normalised text."""
    return F.substring(F.sha2(norm_text(text), 256), 1, 16)


def word_count(text: Column) -> Column:
    """Number of runs of anything but white space, as INT."""
    one = collapse(text)
    blanks = F.length(one) - F.length(F.replace(one, F.lit(" "), F.lit("")))
    return F.when(one == "", F.lit(0)).otherwise(blanks + 1).cast("int")


def preview(text: Column, width: int) -> Column:
    """The first ``width`` code points of the collapsed text."""
    return F.substring(collapse(text), 1, width)


def token_estimate(words: Column) -> Column:
    """1.3 tokens a word, cut to whole numbers."""
    return (words * F.lit(1.3)).cast("int")


def percent(share: Column) -> Column:
    """``62.5 %`` gives ``62``: ties go to the even neighbour, as Python prints them."""
    return F.concat(F.bround(share * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def newlines(text: Column) -> Column:
    """CRLF and CR as LF, the way text-mode reading does it."""
    return F.regexp_replace(text, "\r\n?", "\n")
