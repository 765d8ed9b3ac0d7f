"""Text rules: violations of speakable text, one row each.

A rule is a function from (doc_id, text) rows to (doc_id, rule, message, excerpt, severity, n) rows;
``n`` counts the places of one kind of violation in a document's text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.functions.spoken import element_groups
from studyloom.functions.text import sentences, word_count

# The patterns of the text rules, with what to say about a match.
NOUNS = "figure|table|equation|panel|plot|graph|chart"
CITATIONS = [(r"(?i)\[\s*[0-9]", "bracketed citation"), (r"(?i)\bet\s+al\b", "'et al' should be 'and colleagues'"), (r"(?i)\bdoi\b", "DOI"), (r"(?i)https?://|www\.", "URL")]
WRITTEN_ONLY = [(r"\be\.\s?g\.", "'e.g.' must be 'for example'"), (r"\bi\.\s?e\.", "'i.e.' must be 'that is'"), (r"\bcf\.", "'cf.' must be 'compare'"), (r"\bvs\.", "'vs.' must be 'versus'"), (r"\betc\.", "'etc.' must be 'and so on'"), (r"§|¶|†|‡", "page-only mark")]
DANGLING = [
    (rf"(?i)\bsee\s+(?:the\s+)?(?:{NOUNS}|section|chapter|appendix)\b", "see-reference"),
    (rf"(?i)\b(?:{NOUNS})s?\s+(?:above|below)\b", "spatial reference"),
    (rf"(?i)\bas\s+(?:shown|illustrated|listed|summari[sz]ed|depicted)\s+(?:in|by)\s+the\s+(?:{NOUNS})\b", "visual reference"),
    (r"(?i)\bin\s+the\s+(?:previous|preceding|following|next)\s+(?:chapter|section)\b", "unreachable section"),
    (r"(?i)\b(?:above|below)-mentioned\b", "spatial mention"),
]
UNSPEAKABLE = r"[^\p{L}\p{N}\p{M}\s.,;:!?'—()\[\]{}-]"
NOT_ACRONYMS = "CO DC AC PH UV IR OK II III IV VI".split()
ACRONYM = r"\b[A-Z]{2,6}\b(?=[.,;:]?\s)"
LONGEST_SENTENCE = 35


def _counted(texts: DataFrame, rule: str, patterns: list[tuple[str, str]], severity: str = "error") -> DataFrame:
    found = F.array(*(F.struct(F.lit(label).alias("message"), F.regexp_count("text", F.lit(p)).cast("long").alias("n"), F.regexp_extract("text", p, 0).alias("excerpt")) for p, label in patterns))
    rows = texts.select("doc_id", F.explode(F.filter(found, lambda f: f["n"] > 0)).alias("f"))
    return rows.select("doc_id", F.lit(rule).alias("rule"), "f.message", "f.excerpt", F.lit(severity).alias("severity"), "f.n")


def tts_01(texts: DataFrame) -> DataFrame:
    chars = F.explode(F.regexp_extract_all("text", F.lit(UNSPEAKABLE), 0)).alias("excerpt")
    rows = texts.select("doc_id", chars).groupBy("doc_id", "excerpt").agg(F.count("*").alias("n"))
    return rows.select("doc_id", F.lit("TTS-01").alias("rule"), F.lit("unspeakable character").alias("message"), "excerpt", F.lit("error").alias("severity"), "n")


def num_02(texts: DataFrame) -> DataFrame:
    return _counted(texts, "NUM-02", [(r"[0-9]+(?:[.,][0-9]+)*", "unverbalized number")])


def cit_01(texts: DataFrame) -> DataFrame:
    return _counted(texts, "CIT-01", CITATIONS)


def sent_03(texts: DataFrame) -> DataFrame:
    return _counted(texts, "SENT-03", [(r"[()\[\]{}]", "parenthetical")])


def sent_04(texts: DataFrame) -> DataFrame:
    return _counted(texts, "SENT-04", WRITTEN_ONLY)


def str_08(texts: DataFrame) -> DataFrame:
    return _counted(texts, "STR-08", DANGLING)


def sent_01(texts: DataFrame) -> DataFrame:
    long = F.filter(sentences("text"), lambda s: word_count(s) > LONGEST_SENTENCE)
    rows = texts.select("doc_id", long.alias("long")).filter("size(long) > 0")
    return rows.select("doc_id", F.lit("SENT-01").alias("rule"), F.lit("sentence over the word cap").alias("message"), F.substring(F.get("long", F.lit(0)), 1, 80).alias("excerpt"), F.lit("warning").alias("severity"), F.size("long").cast("long").alias("n"))


def expanded(text: Column, acronym: Column) -> Column:
    """Does the text say anywhere what the letters stand for?"""
    forms = F.concat(F.lit(r",?\s+or\s+"), acronym, F.lit(r"\b|\b"), acronym, F.lit(r"\b\s*(?:refers to|stands for|means|is short for)|\bwe call (?:it|this|them)\s+"), acronym, F.lit(r"\b"))
    return F.regexp_like(text, forms)


def sym_02(texts: DataFrame) -> DataFrame:
    """Acronyms never expanded, once per acronym; words of a run in capitals and compounds are no acronyms."""
    found = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(ACRONYM), 0))).alias("acronym")
    run = F.concat(F.lit(r"(?<![A-Z]{2} )(?<![A-Z]{2}, )\b"), F.col("acronym"), F.lit(r"\b(?![.,;:]? [A-Z]{2})"))
    rows = texts.select("doc_id", "text", found).filter(~F.col("acronym").isin(NOT_ACRONYMS)).filter(~expanded(F.col("text"), F.col("acronym")) & F.regexp_like("text", run))
    said_number = F.regexp_like("text", F.concat(F.lit(r"\b"), F.col("acronym"), F.lit(r"\s+(?i:zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\b")))
    return rows.filter(~(compound(F.col("acronym")) & said_number)).select("doc_id", F.lit("SYM-02").alias("rule"), F.lit("never expanded").alias("message"), F.col("acronym").alias("excerpt"), F.lit("warning").alias("severity"), F.lit(1).cast("long").alias("n"))


def compound(token: Column) -> Column:
    """Is a token in capitals made of one-letter element symbols?"""
    ones = "".join(c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if element_groups(c))
    return token.rlike(f"^[{ones}]+$")


RULES: dict[str, Callable[[DataFrame], DataFrame]] = {"TTS-01": tts_01, "NUM-02": num_02, "CIT-01": cit_01, "SENT-03": sent_03, "SENT-04": sent_04, "STR-08": str_08, "SENT-01": sent_01, "SYM-02": sym_02}


def lint(texts: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """All violations of (doc_id, text) rows under the named rules."""
    out = None
    for name in rules or list(RULES):
        found = RULES[name](texts)
        out = found if out is None else out.unionByName(found)
    return out


def summary(violations: DataFrame) -> DataFrame:
    """Per rule: how many violations in how many documents, errors first."""
    return violations.groupBy("rule", "severity").agg(F.sum("n").alias("violations"), F.count_distinct("doc_id").alias("documents")).orderBy("severity", "rule")
