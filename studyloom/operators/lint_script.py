"""Rules over scripts (beats, cards, concepts) and over finished artefacts; violations as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.config import Profile
from studyloom.functions.spoken import unresolved_opening
from studyloom.functions.text import jaccard, ngrams, sentences, word_count
from studyloom.operators.exposure import exposure_log, spaced
from studyloom.operators.grounding import findings
from studyloom.schema import GENERATED_TYPES, NON_CONTENT_ROLES, TEACHING_TYPES

VERBATIM, RUN = 0.7, 8
# Phrases that mark our own words, and the words that figure, table and furniture rules look for.
OWNERSHIP = ["here's a way to picture it", "my analogy, not theirs", "that's my way of putting it"]
ANNOUNCES_TABLE = r"(?i)\b(?:table|these (?:values|numbers|figures)|the (?:values|numbers|rows)|row by row|column)\b"
ANNOUNCES_FIGURE = r"(?i)\b(?:in the written notes|not described here|see the written|there'?s a figure|there is a figure)\b"
FIGURE_KINDS = r"(?i)\b(?:plots?|graphs?|charts?|diagrams?|schematics?|micrographs?|images?|maps?|photographs?|histograms?|scatter|curves?|pie|box|heat ?maps?|contours?|flow ?charts?)\b"
FIGURE_AXES = r"(?i)\b(?:axis|axes|x[- ]axis|y[- ]axis|horizontal|vertical|against|versus|shares?|slices?|proportions?|percentages?|categor(?:y|ies)|legend|scale bar|rows?|columns?|units?)\b"
FURNITURE = [
    (r"(?i)\bthis work was (?:supported|funded|financed)\b", "funding statement"),
    (r"(?i)\bwe (?:thank|are grateful)\b", "thanks"),
    (r"(?i)\bwe (?:gratefully |also )?acknowledge (?:the |their |generous |financial )*(?:support|funding|assistance|help|contribution|use of|access to)\b", "acknowledgement"),
    (r"(?i)\bthe authors declare\b", "competing-interests boilerplate"),
    (r"(?i)\bcorrespondence should be addressed\b", "correspondence address"),
    (r"(?i)\ball rights reserved\b", "copyright notice"),
    (r"(?i)\bunder (?:a )?creative commons\b", "licence notice"),
    (r"(?i)\bthe (?:remainder|rest) of this (?:paper|article|chapter) is organi[sz]ed\b", "roadmap paragraph"),
    (r"(?i)\bkeywords\b\s*:", "keyword list"),
    (r"(?i)\bgrant (?:number|agreement)\b", "grant number"),
]
VALUE = r"\d+\.\d+|\d{4,}|\d+(?:\.\d+)?\s*(?:%|°|µ|nm|mm|cm|km|kg|mg|mA|mAh|V|W|Hz|K|C)\b"


def _rows(found: DataFrame, rule: str, message: str | Column, excerpt: str | Column = "text", severity: str | Column = "error", beat: bool = True) -> DataFrame:
    as_col = lambda v, lit: v if isinstance(v, Column) else (F.lit(v) if lit else F.col(v))
    return found.select("doc_id", F.lit(rule).alias("rule"), as_col(message, True).alias("message"), F.substring(as_col(excerpt, False), 1, 160).alias("excerpt"), as_col(severity, True).alias("severity"), (F.col("beat_id") if beat else F.lit(None).cast("string")).alias("beat_id"))


def words_of(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit(r"[a-z0-9_'-]+"), 0)


def bag(text: str | Column) -> Column:
    return F.array_distinct(words_of(text))


def runs(text: str | Column, size: int = RUN) -> Column:
    return ngrams(words_of(text), size)


def verbatim(a: Column, b: Column) -> Column:
    """The same words: most of the vocabulary, or a run of eight, shared."""
    return (jaccard(bag(a), bag(b)) > VERBATIM) | F.arrays_overlap(runs(a), runs(b))


def prequestions_from_cards(beats: DataFrame, cards: DataFrame, **_: object) -> DataFrame:
    asked = beats.filter("type = 'prequestion' AND region = 'opening' AND card_id IS NOT NULL")
    closes = beats.filter("type = 'prequestion_close'").select("doc_id", "card_id").distinct()
    strangers = asked.join(cards.select("doc_id", "card_id"), ["doc_id", "card_id"], "left_anti")
    unclosed = asked.join(cards.select("doc_id", "card_id"), ["doc_id", "card_id"], "left_semi").join(closes, ["doc_id", "card_id"], "left_anti")
    counts = cards.groupBy("doc_id").agg(F.count("*").alias("n")).join(asked.groupBy("doc_id").agg(F.count("*").alias("asked")), "doc_id", "left").fillna({"asked": 0})
    off = counts.filter((F.col("asked") < F.least(F.lit(2), F.col("n"))) | (F.col("asked") > 4))
    return _rows(strangers, "STR-02", "prequestion is not in the card pool").unionByName(_rows(unclosed, "STR-02", "prequestion is never closed")).unionByName(_rows(off, "STR-02", F.concat(F.col("asked").cast("string"), F.lit(" prequestions, two to four wanted")), F.lit(""), beat=False))


def section_ends(beats: DataFrame, **_: object) -> DataFrame:
    by = beats.filter("region = 'body'").groupBy("doc_id", "section_id").agg(F.bool_or(F.col("type") == "recap").alias("recap"), F.bool_or(F.col("type") == "prompt").alias("prompt"))
    return _rows(by.filter("NOT recap"), "STR-06", "section has no recap", "section_id", beat=False).unionByName(_rows(by.filter("NOT prompt"), "STR-06", "section has no retrieval prompt", "section_id", beat=False))


def review_interleaved(beats: DataFrame, cards: DataFrame, **_: object) -> DataFrame:
    asked = beats.filter("region = 'review' AND type = 'prompt' AND card_id IS NOT NULL").join(cards.select("doc_id", "card_id", F.col("section_id").alias("home")), ["doc_id", "card_id"], "left")
    before = F.lag("home").over(Window.partitionBy("doc_id").orderBy("seq"))
    return _rows(asked.withColumn("before", before).filter("before = home"), "STR-07", "two consecutive review items from one section", "home")


def segment_duration(beats: DataFrame, profile: Profile, **_: object) -> DataFrame:
    by = beats.filter("region = 'body'").groupBy("doc_id", "section_id", "segment_ix").agg(F.sum(F.col("est_seconds") + F.col("pause_after")).alias("s"))
    by = by.withColumn("last", F.col("segment_ix") == F.max("segment_ix").over(Window.partitionBy("doc_id", "section_id")))
    message = F.when(F.col("s") > profile.segment_hard_max, F.lit("segment over the hard maximum")).when(F.col("s") > profile.segment_max, F.lit("segment over the target")).when((F.col("s") < profile.segment_min) & ~F.col("last"), F.lit("segment too short"))
    severity = F.when(F.col("s") > profile.segment_hard_max, F.lit("error")).otherwise(F.lit("warning"))
    return _rows(by.withColumn("m", message).withColumn("sev", severity).filter("m IS NOT NULL"), "SEG-01", F.col("m"), F.concat_ws("/", "section_id", F.col("segment_ix").cast("string")), F.col("sev"), beat=False)


def new_terms(beats: DataFrame, profile: Profile, **_: object) -> DataFrame:
    taught = beats.filter(F.col("region").eqNullSafe("body") & F.col("type").isin(TEACHING_TYPES)).select("doc_id", "section_id", "segment_ix", "seq", F.explode("concept_ids").alias("c"))
    first_segment = Window.partitionBy("doc_id", "c").orderBy("seq")
    place = F.struct("section_id", "segment_ix")
    fresh = taught.withColumn("first", F.first(place).over(first_segment)).filter(F.col("first") == place)
    worst = fresh.groupBy("doc_id", "section_id", "segment_ix", "seq").agg(F.count_distinct("c").alias("n")).groupBy("doc_id", "section_id", "segment_ix").agg(F.max("n").alias("worst"))
    by = fresh.groupBy("doc_id", "section_id", "segment_ix").agg(F.count_distinct("c").alias("n")).join(worst, ["doc_id", "section_id", "segment_ix"]).filter(F.col("n") > profile.max_new_terms)
    return _rows(by, "SEG-03", F.concat(F.col("n").cast("string"), F.lit(" new terms in a segment")), F.concat_ws("/", "section_id", F.col("segment_ix").cast("string")), F.when(F.col("worst") > profile.max_new_terms, F.lit("warning")).otherwise(F.lit("error")), beat=False)


def prompt_has_answer(beats: DataFrame, **_: object) -> DataFrame:
    following = F.lead("type").over(Window.partitionBy("doc_id", "region", "section_id").orderBy("seq"))
    return _rows(beats.withColumn("following", following).filter("type = 'prompt' AND NOT (following <=> 'answer')"), "RET-01", "prompt has no answer beat")


def prompt_has_pause(beats: DataFrame, profile: Profile, **_: object) -> DataFrame:
    return _rows(beats.filter((F.col("type") == "prompt") & (F.col("pause_after") < profile.retrieval_min)), "PAU-01", "pause under the minimum")


def repeats_not_verbatim(beats: DataFrame, **_: object) -> DataFrame:
    log = exposure_log(beats).filter(F.col("form").isin("statement", "callback", "recap", "anchor"))
    said = log.select("doc_id", "concept_id", "seq", "beat_id").join(beats.select("doc_id", "beat_id", "text"), ["doc_id", "beat_id"])
    earlier = said.select("doc_id", "concept_id", F.col("seq").alias("seq0"), F.col("text").alias("text0"))
    pairs = said.join(earlier, ["doc_id", "concept_id"]).filter("seq0 < seq").filter(verbatim(F.col("text"), F.col("text0")))
    return _rows(pairs.dropDuplicates(["doc_id", "concept_id", "beat_id"]), "REP-01", "exposure repeats an earlier one verbatim")


def minimum_gap(beats: DataFrame, profile: Profile, **_: object) -> DataFrame:
    close = spaced(exposure_log(beats), profile.min_gap_seconds).filter(F.col("gap") < profile.min_gap_seconds)
    return _rows(close, "SPC-01", "met again too soon", "concept_id", F.when(F.col("form") == "callback", F.lit("error")).otherwise(F.lit("warning")))


def grounded(beats: DataFrame, **_: object) -> DataFrame:
    return _rows(beats.filter(~F.col("type").isin(GENERATED_TYPES) & ~F.col("generated") & (F.coalesce(F.size("spans"), F.lit(0)) <= 0)), "GRD-01", "beat has no source span")


def marked_as_ours(beats: DataFrame, **_: object) -> DataFrame:
    said = F.lower("text")
    ours = F.exists(F.array(*map(F.lit, OWNERSHIP)), lambda m: F.contains(said, m))
    return _rows(beats.filter(F.col("type").isin("anchor", "analogy") & ~ours), "VOI-02", "beat does not say it is ours")


def imagery_pause(beats: DataFrame, profile: Profile, **_: object) -> DataFrame:
    return _rows(beats.filter(F.col("type").isin("anchor", "analogy") & (F.col("pause_after") < profile.imagery_min)), "PAU-02", "pause under the minimum")


def facts_grounded(beats: DataFrame, **_: object) -> DataFrame:
    if "written_text" not in beats.columns:
        return _rows(beats.limit(0), "GRD-03", "")
    rows = beats.filter(F.col("type").isin("gloss", "anchor", "analogy", "elaboration") & (F.trim("written_text") != "")).select("doc_id", "beat_id", F.col("text").alias("generated"), F.col("written_text").alias("source"))
    return _rows(findings(rows, kinds=("number", "year", "direction")), "GRD-03", F.concat("kind", F.lit(" not in the cited source")), "value")


def unique_anchors(concepts: DataFrame, **_: object) -> DataFrame:
    key = F.regexp_replace(F.trim(F.lower("anchor")), r"\s+", " ")
    by = concepts.filter("anchor IS NOT NULL").groupBy("doc_id", key.alias("key")).agg(F.count_distinct("canonical").alias("n")).filter("n > 1")
    return _rows(by, "IMG-02", "concepts share an anchor", "key", beat=False)


def analogy_limits(concepts: DataFrame, **_: object) -> DataFrame:
    rows = concepts.filter("analogy IS NOT NULL").withColumn("limit_text", F.coalesce("analogy_limit", F.lit("")))
    none = rows.filter(F.trim("limit_text") == "")
    same = rows.filter((F.trim("limit_text") != "") & (jaccard(bag("limit_text"), bag("analogy")) > VERBATIM))
    return _rows(none, "ANA-01", "analogy states no limit", "analogy", beat=False).unionByName(_rows(same, "ANA-01", "the limit restates the analogy", "limit_text", beat=False))


def whole_sentences(beats: DataFrame, **_: object) -> DataFrame:
    return _rows(beats.filter((F.trim("text") != "") & ~F.trim("text").rlike(r"[.?!:;—]$")), "TTS-04", "beat does not end on a sentence boundary")


def resolved_openings(beats: DataFrame, **_: object) -> DataFrame:
    before = F.lag("generated").over(Window.partitionBy("doc_id", "region", "section_id", "segment_ix").orderBy("seq"))
    rows = beats.withColumn("word", unresolved_opening(F.col("text"))).withColumn("before", before)
    return _rows(rows.filter("word IS NOT NULL AND NOT generated AND (before IS NULL OR before)"), "SENT-02", F.concat(F.lit("beat opens with "), F.col("word")), severity="warning")


def first_sentence(text: str) -> Column:
    return F.coalesce(F.get(sentences(F.trim(F.col(text))), F.lit(0)), F.lit(""))


def table_announced(beats: DataFrame, **_: object) -> DataFrame:
    return _rows(beats.filter((F.col("type") == "table") & (F.trim("text") != "") & ~first_sentence("text").rlike(ANNOUNCES_TABLE)), "TBL-02", "table beat does not say that it is a table", first_sentence("text"))


def figure_template(beats: DataFrame, **_: object) -> DataFrame:
    rows = beats.filter((F.col("type") == "figure") & (F.trim("text") != "") & ~F.col("text").rlike(ANNOUNCES_FIGURE))
    long = rows.filter(F.length(first_sentence("text")) > 125)
    kind = rows.filter(~F.col("text").rlike(FIGURE_KINDS))
    axes = rows.filter(F.col("text").rlike(FIGURE_KINDS) & ~F.col("text").rlike(FIGURE_AXES))
    out = _rows(long, "FIG-01", "opening statement over the title cap", severity="warning")
    return out.unionByName(_rows(kind, "FIG-01", "description never says what kind of figure it is", severity="warning")).unionByName(_rows(axes, "FIG-01", "description never names the axes", severity="warning"))


def distinct_answers(cards: DataFrame, **_: object) -> DataFrame:
    core = F.trim(F.regexp_replace("answer", r"(?i)^Here's the answer about .*?\.\s*", ""))
    by = cards.groupBy("doc_id", core.alias("core")).agg(F.count("*").alias("n")).filter("n > 1 AND core <> ''")
    return _rows(by, "RET-06", F.concat(F.lit("one sentence answers "), F.col("n").cast("string"), F.lit(" questions")), "core", "warning", beat=False)


def true_transitions(beats: DataFrame, window: int = 3, **_: object) -> DataFrame:
    ahead = F.flatten(F.collect_list("concept_ids").over(Window.partitionBy("doc_id").orderBy("seq").rowsBetween(1, window)))
    rows = beats.withColumn("ahead", ahead).filter((F.col("type") == "transition") & (F.size("concept_ids") > 0))
    return _rows(rows.filter(~F.arrays_overlap("concept_ids", "ahead")), "SEG-04", "announces what the next beats are not about", severity="warning")


def drop_list(blocks: DataFrame, audio: DataFrame, **_: object) -> DataFrame:
    """Dropped furniture that was narrated, and furniture in the audio wherever it came from."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    listed = blocks.filter((F.col("triage.action") == "drop") & (F.col("triage.rule") == "COH-01") & (F.col("role").isin(NON_CONTENT_ROLES) | F.col("kind").isin("page_artifact", "reference")))
    lines = listed.select("doc_id", "ord", F.explode(sentences("text")).alias("sentence")).filter(word_count("sentence") >= 8)
    leaks = lines.join(audio.select("doc_id", flat(F.col("audio")).alias("spoken")), "doc_id").filter(F.contains("spoken", flat(F.col("sentence")))).groupBy("doc_id", "ord").agg(F.min("sentence").alias("sentence"))
    found = F.array(*(F.struct(F.lit(label).alias("label"), F.regexp_extract("audio", p, 0).alias("hit")) for p, label in FURNITURE))
    inside = audio.select("doc_id", F.explode(F.filter(found, lambda f: f["hit"] != "")).alias("f")).select("doc_id", "f.*")
    return _rows(leaks, "COH-01", "dropped, but narrated anyway", "sentence", beat=False).unionByName(_rows(inside, "COH-01", F.concat("label", F.lit(" reached the audio track")), "hit", beat=False))


def equations_written(blocks: DataFrame, study: DataFrame, **_: object) -> DataFrame:
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    rows = blocks.filter((F.col("kind") == "equation") & (F.trim("text") != "")).join(study.select("doc_id", flat(F.col("study")).alias("written")), "doc_id", "left")
    return _rows(rows.filter(~F.contains(F.coalesce("written", F.lit("")), flat(F.col("text")))), "MTH-04", "equation is not in the written track", beat=False)


def values_written(beats: DataFrame, study: DataFrame, **_: object) -> DataFrame:
    """Exact values of narrated sources that the written track lost, once per value."""
    if "written_text" not in beats.columns:
        return _rows(beats.limit(0), "NUM-06", "")
    rows = beats.filter((F.col("type") != "prompt") & (F.size("spans") > 0)).select("doc_id", "seq", "beat_id", F.explode(F.array_distinct(F.regexp_extract_all("written_text", F.lit(VALUE), 0))).alias("value"))
    first = rows.groupBy("doc_id", F.trim("value").alias("value")).agg(F.min_by("beat_id", "seq").alias("beat_id")).join(study, "doc_id", "left")
    return _rows(first.filter(~F.contains(F.coalesce("study", F.lit("")), F.col("value"))), "NUM-06", "value is narrated but not written", "value")


SCRIPT_RULES: dict[str, Callable[..., DataFrame]] = {
    "STR-02": prequestions_from_cards, "STR-06": section_ends, "STR-07": review_interleaved, "SEG-01": segment_duration, "SEG-03": new_terms, "RET-01": prompt_has_answer, "PAU-01": prompt_has_pause,
    "REP-01": repeats_not_verbatim, "SPC-01": minimum_gap, "GRD-01": grounded, "VOI-02": marked_as_ours, "PAU-02": imagery_pause, "GRD-03": facts_grounded, "IMG-02": unique_anchors, "ANA-01": analogy_limits,
    "TTS-04": whole_sentences, "SENT-02": resolved_openings, "TBL-02": table_announced, "FIG-01": figure_template, "RET-06": distinct_answers, "SEG-04": true_transitions,
}
ARTEFACT_RULES: dict[str, Callable[..., DataFrame]] = {"COH-01": drop_list, "MTH-04": equations_written, "NUM-06": values_written}
#: The tables a rule needs besides beats.
NEEDS = {"STR-02": {"cards"}, "STR-07": {"cards"}, "RET-06": {"cards"}, "IMG-02": {"concepts"}, "ANA-01": {"concepts"}, "COH-01": {"blocks", "audio"}, "MTH-04": {"blocks", "study"}, "NUM-06": {"study"}}


def lint_script(beats: DataFrame, profile: Profile | None = None, **tables: DataFrame) -> tuple[DataFrame, list[str]]:
    """(violations of all rules whose tables are given, names of the rules skipped)."""
    out, skipped = None, []
    for name, rule in {**SCRIPT_RULES, **ARTEFACT_RULES}.items():
        if NEEDS.get(name, set()) - tables.keys():
            skipped.append(name)
            continue
        found = rule(beats=beats, profile=profile or Profile(), **tables)
        out = found if out is None else out.unionByName(found)
    return out, skipped


def counts(violations: DataFrame) -> DataFrame:
    return violations.groupBy("rule", "severity").agg(F.count("*").alias("n")).orderBy("severity", "rule")
