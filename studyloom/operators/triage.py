"""Triage: what is worth saying, with a recorded reason, as one ordered CASE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.functions.text import seconds_for, spaced, word_count, words
from studyloom.schema import NON_CONTENT_ROLES

MATH_PLACEHOLDER = "inline-eq"

# Furniture kinds, kinds that need a verbalizer, and the commonest function words.
DROP_KINDS = ["page_artifact", "reference"]
TRANSFORM_KINDS = ["table", "figure", "equation", "code"]
FUNCTION_WORDS = "the a an of in to for and or is are was were with that this by on as at from be been it its which we our their have has had than these those but not".split()
MIN_NOT_PROSE_WORDS, MIN_PARAGRAPH_WORDS, MAX_MATH_PLACEHOLDERS = 8, 4, 2

# The boilerplate patterns in order of precedence; the first that matches names the reason.
_MARK = r"[\s*■▪•·†‡§#|_-]*"
_LABEL = r"(?:[A-Za-z][A-Za-z' -]{2,40}:\s*)?"
_BACK = (
    r"author\s+information|author\s+contributions?|acknowledge?ments?|acknowledgements?|associated\s+content|supporting\s+information"
    r"|conflicts?\s+of\s+interest|competing\s+(financial\s+)?interests?|declarations?\s+of\s+(competing\s+)?interest|funding(\s+sources?)?"
    r"|abbreviations?\s+used|data\s+availability"
)
BOILERPLATE = [
    ("paper roadmap", rf"^{_MARK}the\s+(remainder|rest)\s+of\s+th(is|e)\s+(paper|article|manuscript|chapter)\s+is\s+organi[sz]ed"),
    ("declaration", rf"^{_MARK}{_LABEL}(the\s+authors?\s+declare|no\s+conflicts?\s+of\s+interest|all\s+authors?\s+(have\s+)?(read|approved)|data\s+(will\s+be\s+)?available)"),
    ("copyright", r"©|\ball rights reserved\b|\bcreative commons\b|\bunder a cc[- ]by\b"),
    ("license", rf"^{_MARK}(this is an open access article|licen[sc]ed under)"),
    ("submission dates", rf"^{_MARK}(?:manuscript\s+)?(?:received|submitted)\b.{{0,160}}\b(?:accepted|revised|published)\b"),
    ("graphical abstract furniture", rf"^{_MARK}(graphical abstract|highlights|in brief|key ?points)\s*:?\s*$"),
    ("correspondence", rf"^{_MARK}(correspondence|corresponding author)\b"),
    ("keyword list", rf"^{_MARK}\**\s*key\s?words?\s*\**\s*:"),
    ("panel labels", rf"^{_MARK}[(\[]?[a-h][)\]]?(?:[\s,;]+[(\[]?[a-h][)\]]?){{1,7}}\s*$"),
    ("pointer to material the listener cannot reach", r"\b(supplement(al|ary)\s+(information|material|data)|(data|code)\s+(and\s+\w+\s+)?(is|are)\s+available)\b.{0,80}\b(online|at|from|upon request|in the (repository|appendix))\b"),
    ("article type banner", rf"^{_MARK}(research(\s+article)?|original\s+(research|article)|review(\s+article)?|article|letter|communication|perspective|editorial|mini[- ]?review)\s*$"),
    ("back matter", rf"^{_MARK}({_BACK})\b"),
    ("journal citation line", r"^.{0,120}\(\s*(19|20)\d{2}\s*\).{0,80}(10\.\d{4,9}/|doi)"),
]


def boilerplate_reason(text: str | Column = "text") -> Column:
    """The name of the first pattern that matches, or null."""
    t = F.col(text) if isinstance(text, str) else text
    out = None
    for name, pattern in BOILERPLATE:
        hit = t.rlike(f"(?is){pattern}")
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def reads_as_prose(text: str | Column = "text") -> Column:
    """Short runs pass; longer ones need a function word."""
    bare = F.transform(words(text), lambda w: F.regexp_replace(F.lower(w), r"^[.,;:()\[\]’'\"]+|[.,;:()\[\]’'\"]+$", ""))
    return (word_count(text) < MIN_NOT_PROSE_WORDS) | F.exists(bare, lambda w: w.isin(FUNCTION_WORDS))


def decide(kind: Column, role: Column, text: Column) -> Column:
    """struct(action, rule, reason, confidence) by the first rule that applies."""

    def as_(action: str, rule: str, reason: Column | str, confidence: float = 1.0) -> Column:
        return F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), F.lit(confidence).alias("confidence"))

    placeholders = (F.length(text) - F.length(F.replace(text, F.lit(MATH_PLACEHOLDER), F.lit("")))) / len(MATH_PLACEHOLDER)
    boilerplate = boilerplate_reason(text)
    short = (kind == "paragraph") & (word_count(text) < MIN_PARAGRAPH_WORDS) & ~F.rtrim(spaced(text)).rlike(r"[.!?]$")
    return (
        F.when(kind.isin(DROP_KINDS), as_("drop", "COH-01", F.concat(kind, F.lit(" is page furniture"))))
        .when(role.isin("title", "authors"), as_("drop", "COH-01", "front matter, spoken by the orientation block instead (STR-01)"))
        .when(role.isin(NON_CONTENT_ROLES), as_("drop", "COH-01", F.concat(role, F.lit(" carries no content"))))
        .when(boilerplate.isNotNull(), as_("drop", "COH-01", boilerplate))
        .when(~kind.isin(TRANSFORM_KINDS) & ~reads_as_prose(text), as_("drop", "COH-01", "no function words: a table, an axis, a contents page or front matter", 0.8))
        .when(kind.isin(TRANSFORM_KINDS), as_("transform", "COH-04", F.concat(kind, F.lit(" needs verbalizing, not reading"))))
        .when(placeholders > MAX_MATH_PLACEHOLDERS, as_("transform", "COH-04", "prose depends on inline mathematics that the text layer does not hold"))
        .when(short, as_("drop", "COH-01", "fragment, too short to be a sentence", 0.6))
        .when((role == "methods") & (kind == "paragraph"), as_("compress", "COH-02", "methods detail is summarised, not read in full", 0.8))
        .otherwise(as_("keep", "COH-04", "carries the argument"))
    )


def triage(blocks: DataFrame) -> DataFrame:
    """``blocks`` with a ``triage`` struct; blocks that already have one are left alone."""
    if "triage" in blocks.columns:
        return blocks
    return blocks.withColumn("triage", decide(F.coalesce("kind", F.lit("unknown")), F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))))


def is_retained() -> Column:
    return (F.col("triage.action") != "drop") & (F.trim(spaced("text")) != "")


def retained(blocks: DataFrame) -> DataFrame:
    return blocks.filter(is_retained())


def dropped(blocks: DataFrame) -> DataFrame:
    return blocks.filter(F.col("triage.action") == "drop")


def summary(blocks: DataFrame, wpm: int = 155) -> DataFrame:
    """Per document: blocks by action, words kept and the length of a straight read."""
    count = lambda a: F.count_if(F.col("triage.action") == a)
    keep = F.col("triage.action") != "drop"
    total, kept = F.sum("n_words"), F.sum(F.when(keep, F.col("n_words")).otherwise(0))
    return (
        blocks.withColumn("n_words", word_count("text").cast("long"))
        .groupBy("doc_id")
        .agg(F.count("*").alias("n_blocks"), *(count(a).alias(f"n_{a}") for a in ("keep", "compress", "transform", "drop")), total.alias("words_total"), kept.alias("words_kept"))
        .withColumn("retained_pct", F.when(F.col("words_total") == 0, F.lit(0).cast("long")).otherwise(F.expr("100 * words_kept div words_total")))
        .withColumn("est_seconds", F.round(F.col("words_kept") * 60.0 / wpm, 6))
    )


def drop_report(blocks: DataFrame, examples: int = 4) -> DataFrame:
    """Per (rule, reason): blocks, words and the first few examples by (doc_id, ord)."""
    rows = dropped(blocks).select("doc_id", "ord", F.col("triage.rule").alias("rule"), F.col("triage.reason").alias("reason"), word_count("text").cast("long").alias("n_words"), F.substring("text", 1, 160).alias("example"))
    firsts = rows.groupBy("rule", "reason").agg(F.count("*").alias("n_blocks"), F.sum("n_words").alias("n_words"), *(F.min(F.struct("doc_id", "ord", "example")).alias("first"),))
    return firsts.select("rule", "reason", "n_blocks", "n_words", F.col("first.example").alias("example")) if examples else firsts.drop("first")


def est_read(blocks: DataFrame, wpm: int = 155) -> DataFrame:
    return retained(blocks).groupBy("doc_id").agg(F.sum(seconds_for("text", wpm)).alias("est_seconds"))
