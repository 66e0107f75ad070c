"""Column expressions for text: splitting, tokens, terms, cleaning.

Every function returns a ``Column`` built from JVM-side built-ins so that it
stays inside whole-stage codegen. The regular expressions are written so
that Java regex (Spark) and RE2 (DuckDB, used by the oracle SQL) give the
same matches: no lookaround, no ``\\s``/``\\w`` (their Unicode coverage
differs between the two engines).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Code points Python's ``str.split()`` treats as whitespace (BMP).
WS_CLASS = (
    "\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
    "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
)
WS = f"[{WS_CLASS}]+"
# A whitespace-delimited word (``str.split()`` element).
WORD = f"[^{WS_CLASS}]+"
# A word with the white space before it.
SPACED_WORD = f"[{WS_CLASS}]*[^{WS_CLASS}]+"
# Word-or-punctuation token: a run of letters/digits/underscore, or any
# single other non-space character.
TOKEN = f"[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_{WS_CLASS}]"
# TF-IDF term: two or more word characters (applied to lower-cased text).
TERM = "[\\p{L}\\p{N}_]{2,}"
NON_WORD = "[^\\p{L}\\p{N}_]+"
# Citation marker ``[n]``.
MARKER = "\\[[0-9]+\\]"
NON_ASCII = "[^\\x00-\\x7F]+"
# ----------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def words(col) -> Column:
    """``text.split()`` as an array of strings: a split on whitespace runs,
    empty ends dropped (about 4x faster in Spark than extracting every
    non-space run)."""
    return F.array_remove(F.split(_c(col), WS), "")


def word_count(col) -> Column:
    return F.size(words(col)).cast("bigint")


def tokens(col) -> Column:
    """Words and punctuation marks, case kept."""
    return F.regexp_extract_all(_c(col), F.lit(TOKEN), 0)


def token_count(col) -> Column:
    return F.size(tokens(col)).cast("bigint")


def terms(col) -> Column:
    """Lower-cased terms of two or more word characters (TF-IDF vocabulary):
    the maximal runs of word characters (a split on non-word runs), those of
    length 1 dropped."""
    return F.filter(F.split(F.lower(_c(col)), NON_WORD), lambda x: F.length(x) >= 2)


def py_strip(col) -> Column:
    """``str.strip()``: drop leading and trailing whitespace of every kind."""
    return F.regexp_replace(_c(col), f"^{WS}|{WS}$", "")


def collapse_ws(col) -> Column:
    """Whitespace runs become one space; ends trimmed."""
    return py_strip(F.regexp_replace(_c(col), WS, " "))


def strip_non_ascii(col) -> Column:
    return F.regexp_replace(_c(col), NON_ASCII, "")


def first_words(col, n: int = 5) -> Column:
    """The first ``n`` whitespace words joined by one space (a title)."""
    return F.array_join(F.slice(words(col), 1, n), " ")


def round6(col) -> Column:
    """Scores are rounded before ranking and output: double sums depend on
    addition order, so the last digits are not stable across plans."""
    return F.round(_c(col).cast("double"), 6)
