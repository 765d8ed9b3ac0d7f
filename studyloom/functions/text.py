"""Column helpers for words, sentences and signatures.

Expressions that have a SQL oracle use ASCII classes and no lookaround, so that both engines read
them alike; a no-break space counts as a space.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NBSP = "\u00a0"
MARK = "\x01"

# Abbreviations whose full stop does not end a sentence.
ABBREVIATIONS = "fig figs eq eqs ref refs tab no vs cf al et e.g i.e approx ca dr prof mr mrs ms st vol pp ed eds min max sec chap resp".split()


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: a lambda binds it, so the optimizer cannot copy it into other lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spaced(text: str | Column) -> Column:
    return F.replace(F.coalesce(col(text), F.lit("")), F.lit(NBSP), F.lit(" "))


def words(text: str | Column) -> Column:
    """White-space separated words; none for a blank text."""
    t = F.regexp_replace(spaced(text), r"^\s+|\s+$", "")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\s+"))


def word_count(text: str | Column) -> Column:
    t = F.regexp_replace(spaced(text), r"^\s+|\s+$", "")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"\s+")))


def seconds_for(text: str | Column, wpm: int = 155) -> Column:
    return word_count(text) * F.lit(60.0) / F.lit(float(wpm))


def sentences(text: str | Column) -> Column:
    """Sentences cut after ``.``, ``!`` or ``?`` and white space (no abbreviation guards)."""
    marked = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"([.!?])\s+", f"$1{MARK}")
    return F.filter(F.split(marked, MARK), lambda s: F.trim(s) != "")


def guarded_sentences(text: str | Column) -> Column:
    """Sentences with the guards: no cut after an abbreviation, a single initial or ``digit.``."""
    alternatives = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    guard = rf"(?<!(?i:\b(?:{alternatives}))\.)(?<!\b[A-Z]\.)(?<!\d\.)"
    marked = F.regexp_replace(F.coalesce(col(text), F.lit("")), rf"(?<=[.!?]){guard}[\"')\]]*\s+", MARK)
    return F.filter(F.split(marked, MARK), lambda s: F.trim(s) != "")


def tokens(text: str | Column) -> Column:
    """Lower-case words of letters, digits, ``'`` and ``-`` that begin with a letter."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(r"[a-z][a-z0-9'_-]*"), 0)


def ngrams(tokens_col: str | Column, size: int) -> Column:
    none = F.array().cast("array<string>")
    return let(col(tokens_col), lambda t: F.when(F.size(t) >= size, F.transform(F.sequence(F.lit(1), F.size(t) - (size - 1)), lambda i: F.array_join(F.slice(t, i, size), " "))).otherwise(none))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Of two arrays as sets; 0 when either is empty."""
    return let(F.struct(col(a).alias("a"), col(b).alias("b")), lambda p: F.when((F.size(p["a"]) == 0) | (F.size(p["b"]) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(p["a"], p["b"])) / F.size(F.array_union(p["a"], p["b"]))))


def signature(text: str | Column) -> Column:
    """What stays of a running head from page to page: digits folded, white space gone, 120 characters."""
    lines = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?m)^\s*[A-Za-z0-9]\s*$\n?", "")
    joined = F.trim(F.regexp_replace(lines, r"\n", " "))
    edges = F.regexp_replace(joined, r"^[A-Za-z0-9]\s+|\s+[A-Za-z0-9]$", "")
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(edges), r"[0-9]+", "#"), r"\s+", ""), 1, 120)


def clip(text: str | Column, length: int) -> Column:
    t = col(text)
    return F.when(F.length(t) <= length, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, length - 1)), F.lit("\u2026")))
