"""Grounding: what a generated text says that its source does not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.functions.text import sentences as split_sentences
from studyloom.functions.text import word_count

# Opposite directions.
DIRECTIONS = [
    ("increase", "decrease"), ("increases", "decreases"), ("increased", "decreased"), ("increasing", "decreasing"), ("rise", "fall"), ("rises", "falls"), ("rose", "fell"), ("rising", "falling"),
    ("grow", "shrink"), ("grows", "shrinks"), ("grew", "shrank"), ("higher", "lower"), ("greater", "smaller"), ("more", "less"), ("faster", "slower"), ("thicker", "thinner"), ("longer", "shorter"),
    ("above", "below"), ("gains", "loses"), ("improves", "worsens"), ("accelerates", "slows"), ("expands", "contracts"),
]
# Capitalised words that are no names.
COMMON = (
    "a an the and or but so if then than that this these those there here when where while because although however therefore thus hence instead unlike each every both either neither it its it's they them their we our you your he she his her i"
    " in on at by for from with without into onto over under across through during after before is are was were be been being has have had do does did can could may might must should will would shall not no yes one two three four five six seven eight nine ten first second third figure table equation section chapter appendix panel page note picture imagine think consider suppose remember notice"
).split()


def canonical_number(token: Column) -> Column:
    """One spelling for a number: thousands commas gone, a decimal comma or raised point a point, no trailing zeros."""
    t = F.replace(F.replace(token, F.lit("·"), F.lit(".")), F.lit(" "), F.lit(""))
    tail = F.regexp_extract(t, r",(\d*)$", 1)
    decimal = F.contains(t, F.lit(",")) & ~F.contains(t, F.lit(".")) & (F.length(tail) != 3)
    point = F.when(decimal, F.regexp_replace(t, r",(\d*)$", ".$1")).otherwise(t)
    point = F.replace(point, F.lit(","), F.lit(""))
    short = F.when(F.contains(point, F.lit(".")), F.regexp_replace(F.regexp_replace(point, "0+$", ""), r"\.$", "")).otherwise(point)
    whole = F.regexp_replace(short, r"^0+(?=[0-9])", "")
    return F.when(whole == "", F.lit("0")).when(whole.startswith("."), F.concat(F.lit("0"), whole)).otherwise(whole)


def numbers_in(text: Column) -> Column:
    """Distinct canonical numbers of a text."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[0-9][0-9.,·]*"), 0)
    return F.array_distinct(F.transform(F.transform(raw, lambda t: F.regexp_replace(t, "[.,]+$", "")), canonical_number))


def years_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<!\d)(1[6-9]\d{2}|20\d{2})(?!\d)"), 1))


def names_in(text: Column) -> Column:
    """Capitalised words inside a sentence that are neither acronyms nor common words."""
    inside = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![.!?:;]\s)(?<![.!?:;]\s\s)(?<!\n)(?<!^)\b(\p{Lu}[\w'-]*\p{Ll}[\w'-]*)"), 1)
    return F.array_distinct(F.filter(inside, lambda w: ~F.lower(w).isin(COMMON)))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z][a-z0-9_'-]*"), 0))


def flipped(generated: Column, source: Column) -> Column:
    """Directions said where the source only has the opposite."""
    said, there = word_set(generated), word_set(source)
    pairs = F.array(*(F.struct(F.lit(a).alias("used"), F.lit(b).alias("opposite")) for p in DIRECTIONS for a, b in (p, p[::-1])))
    wrong = F.filter(pairs, lambda p: F.array_contains(said, p["used"]) & ~F.array_contains(there, p["used"]) & F.array_contains(there, p["opposite"]))
    return F.transform(wrong, lambda p: p["used"])


def findings(rows: DataFrame, generated: str = "generated", source: str = "source", kinds: tuple[str, ...] = ("number", "year", "name", "direction")) -> DataFrame:
    """``rows``' other columns with (kind, value, severity): one row per unsupported claim."""
    g, s = F.col(generated), F.coalesce(F.col(source), F.lit(""))
    tag = lambda kind, values, severity: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(severity).alias("severity")))
    parts = {
        "number": tag("number", F.array_except(numbers_in(g), numbers_in(s)), "error"),
        "year": tag("year", F.filter(years_in(g), lambda y: ~F.contains(s, y)), "error"),
        "name": tag("name", F.filter(names_in(g), lambda n: ~F.array_contains(word_set(s), F.lower(n))), "warning"),
        "direction": tag("direction", flipped(g, s), "error"),
    }
    keep = [c for c in rows.columns if c not in (generated, source)]
    return rows.select(*keep, F.explode(F.concat(*(parts[k] for k in kinds))).alias("f")).select(*keep, "f.*")


def verdicts(rows: DataFrame, keys: list[str], **names: str) -> DataFrame:
    """(keys, verified): no finding of error severity."""
    bad = findings(rows, **names).filter("severity = 'error'").select(*keys).distinct().withColumn("failed", F.lit(True))
    return rows.select(*keys).distinct().join(bad, keys, "left").select(*keys, F.col("failed").isNull().alias("verified"))


def lost_numbers(original: Column, split: Column) -> Column:
    """Numbers of a sentence that its split form no longer has."""
    return F.array_except(numbers_in(original), numbers_in(split))


def verify_split(original: Column, split: Column, most_words: int = 25, growth: float = 1.5) -> Column:
    """Why a split sentence is refused, as an array of reasons; empty when it is accepted."""
    parts = split_sentences(split)
    reasons = F.array(
        F.when(F.size(parts) < 2, F.lit("not split")),
        F.when(F.exists(parts, lambda p: word_count(p) > most_words), F.lit("a part is too long")),
        F.when(word_count(split) > growth * word_count(original), F.lit("grew too much")),
        F.when(F.size(lost_numbers(original, split)) > 0, F.lit("lost a number")),
        F.when(F.size(F.array_except(numbers_in(split), numbers_in(original))) > 0, F.lit("invented a number")),
        F.when(F.size(flipped(split, original)) > 0, F.lit("flipped a direction")),
    )
    return F.array_compact(reasons)
