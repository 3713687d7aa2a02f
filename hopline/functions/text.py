"""Text predicates over tokens: runs of letters and digits, A-Z folded to lower case."""

from __future__ import annotations

from functools import reduce

import regex
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)
#: Edits allowed by default: none up to 2 characters, one up to 5, else two.
EDITS = ((2, 0), (5, 1))
MOST_EDITS = 2


#: What stands between tokens, for the regular expressions of Java and, where no JVM runs yet, of Python's ``regex``.
BETWEEN, BETWEEN_PY = r"[^\p{IsAlphabetic}\p{N}]+", regex.compile(r"[^\p{Alphabetic}\p{N}]+")


def tokens_of(text: str) -> list[str]:
    """The tokens of a driver-side text, cut by the expression that cuts columns, in the same JVM if there is one."""
    sc = SparkContext._active_spark_context
    cut = sc._jvm.java.util.regex.Pattern.compile(BETWEEN).split(text) if sc is not None and sc._jvm is not None else BETWEEN_PY.split(text)
    return [t.translate(_FOLD) for t in cut if t]


def tokens(text: Column) -> Column:
    """array<string> of a column's tokens; null stays null.

    ``lower`` is much cheaper than ``translate`` but also folds letters beyond
    A-Z, so it serves the texts that have none.
    """
    folded = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(folded, BETWEEN), lambda t: t != "")


#: Prefix of a column that holds the tokens of a text, in order, so that queries need not cut it.
STORED = "__tokens_"


def count(text: Column, stored: Column | None = None) -> Column:
    """The number of tokens, without making them; null for null."""
    if stored is not None:
        return F.when(stored.isNotNull(), F.size(stored))
    return F.regexp_count(text, F.lit(r"[\p{IsAlphabetic}\p{N}]+"))


def may_hold(text: Column, token: str) -> Column:
    """A cheap test that every text with the token passes: texts that fail it need not be cut."""
    return F.contains(F.lower(text), F.lit(token)) if token.isascii() else F.lit(True)


def times(text: Column, token: str, stored: Column | None = None, low: Column | None = None) -> Column:
    """How often a token stands in the text; 0 for null.  ``low`` is the text in lower case, where it is at hand."""
    if stored is not None:
        held = F.size(F.filter(stored, lambda t: t == token))
        return F.when(F.array_contains(stored, token), held).otherwise(0)
    own = F.size(F.filter(tokens(text), lambda t: t == token))
    hold = may_hold(text, token) if low is None or not token.isascii() else F.contains(low, F.lit(token))
    return F.when(hold, own).otherwise(0)


def default_edits(token: str) -> int:
    return next((k for size, k in EDITS if len(token) <= size), MOST_EDITS)


def _sure(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def _may_hold_all(text: Column, asked: list[str]) -> Column:
    return reduce(Column.__and__, [may_hold(text, t) for t in asked])


def search(field: Column, query: str | Column, stored: Column | None = None) -> Column:
    """Whether the field has every token of the query; false for nulls and empty queries.

    With ``stored`` tokens the field itself isn't read, here and below.
    """
    own = tokens(field) if stored is None else stored
    if isinstance(query, Column):
        asked = tokens(query)
        return _sure((F.size(asked) > 0) & (F.size(F.array_except(asked, own)) == 0))
    asked = sorted(set(tokens_of(query or "")))
    if not asked:
        return F.lit(False)
    if stored is not None:
        return _sure(reduce(Column.__and__, [F.array_contains(stored, t) for t in asked]))
    held = F.size(F.array_intersect(own, F.array(*map(F.lit, asked)))) == len(asked)
    return _sure(F.when(_may_hold_all(field, asked), held))


def match_text(field: Column, query: str | Column, stored: Column | None = None) -> Column:
    """Whether the query's tokens stand in the field one after the other."""

    def padded(own: Column) -> Column:
        return F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" "))

    own = padded(tokens(field) if stored is None else stored)
    if isinstance(query, Column):
        asked = tokens(query)
        return _sure((F.size(asked) > 0) & F.contains(own, padded(asked)))
    asked = tokens_of(query or "")
    if not asked:
        return F.lit(False)
    phrase = F.contains(own, F.lit(f" {' '.join(asked)} "))
    if stored is not None:
        return _sure(F.when(reduce(Column.__and__, [F.array_contains(stored, t) for t in sorted(set(asked))]), phrase))
    return _sure(F.when(_may_hold_all(field, asked), phrase))


def _near(own: Column, token: str, edits: int) -> Column:
    """Whether some token is within so many edits; the three-argument distance gives up (-1) beyond."""
    return F.exists(own, lambda f: F.levenshtein(f, F.lit(token), edits) >= 0)


def fuzzy(field: Column, query: str | Column, edits: int | None = None, stored: Column | None = None) -> Column:
    """Whether each token of the query is within its edits of some token of the field."""
    own = tokens(field) if stored is None else stored
    if isinstance(query, Column):
        asked = tokens(query)

        def near(t: Column) -> Column:
            allowed = F.lit(edits) if edits is not None else F.when(F.length(t) <= 2, 0).when(F.length(t) <= 5, 1).otherwise(MOST_EDITS)
            return F.exists(own, lambda f: F.levenshtein(f, t) <= allowed)

        return _sure((F.size(asked) > 0) & F.forall(asked, near))
    asked = sorted(set(tokens_of(query or "")))
    if not asked:
        return F.lit(False)
    out = F.lit(True)
    for t in asked:
        k = default_edits(t) if edits is None else edits
        out &= F.array_contains(own, t) if k == 0 else _near(own, t, k)
    return _sure(out)
