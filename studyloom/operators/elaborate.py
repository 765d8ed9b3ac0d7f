"""Elaboration as tables: planned requests, answers checked and stored, outcomes with their reasons.

Nothing here calls a model: answers are rows (a fixtures table, a cache, a person), joined by digest.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.config import Profile
from studyloom.functions.text import word_count
from studyloom.operators.concepts import ranked
from studyloom.operators.grounding import findings, verify_split
from studyloom.schema import request_digest

# Limits of the answers' fields (characters unless words), and the kinds of claims checked per task.
LIMITS = {"gloss": {"short_def": 200, "long_def": 600}, "anchor": {"text": 400}, "analogy": {"text": 400, "limit": 300}, "why": {"text": 500}, "compress": {"text": 1200}, "figure": {"statement": 125, "kind": 120, "axes": 300, "trend": 400, "exceptions": 300, "claim": 300}, "verify": {"evidence": 600, "note": 300}}
OPTIONAL = {"exceptions", "spoken", "evidence", "note"}
ANCHOR_WORDS, FIGURE_CONFIDENCE, SPLIT_WORDS = 40, 0.6, 25
CHECKED = {"gloss": ("number", "year", "direction"), "why": ("number", "year", "direction"), "anchor": ("number", "year"), "analogy": ("number", "year"), "figure": ("number", "year", "direction")}
ABSENCES = ["not configured", "unreachable", "refused", "rejected", "over budget"]

#: What each task asks, as ``format_string`` templates over (term, source).
INSTRUCTIONS = {
    "gloss": "Explain %s in one line and then in at most three sentences, from these sentences only: %s",
    "anchor": "Give one concrete scene, in at most forty words, that stands for %s: %s",
    "why": "Say in one or two sentences why this holds for %s, from these sentences only: %s",
    "analogy": "Give an analogy for %s and say where it breaks down: %s",
    "figure": "Describe the figure %s: statement, kind, axes, trend, exceptions, claim, confidence. Its caption and mentions: %s",
    "split": "Cut this sentence into two to six short ones without losing or adding a value %s: %s",
    "compress": "Say this in fewer words%s: %s",
    "verify": "Does the source entail this statement about %s? %s",
}


def over_long(sentences: DataFrame, most_words: int = SPLIT_WORDS) -> DataFrame:
    """Narrated sentences over the cap, the longest first."""
    return sentences.withColumn("n_words", word_count("text")).filter(F.col("n_words") > most_words).orderBy(F.desc("n_words"), "doc_id", "ord", "sent_ix")


def plan_requests(concepts: DataFrame, supports: DataFrame, long_sentences: DataFrame | None = None, figures: DataFrame | None = None, profile: Profile | None = None) -> DataFrame:
    """(doc_id, position, task, subject_id, instruction, digest): the requests in the order that spends the budget.

    Per concept gloss, anchor and why; then analogies, figures and splits, each within its cap.
    """
    p = profile or Profile()
    pool = supports.groupBy("doc_id", "concept_id").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rank", "text"))), 1, 6), lambda s: s["text"]), " ").alias("source"))
    top = ranked(concepts.filter("budget > 0"), p.max_concepts).join(pool, ["doc_id", "concept_id"])
    anchored = F.row_number().over(Window.partitionBy("doc_id", F.col("abstractness") >= p.anchor_abstractness).orderBy("rank"))
    top = top.withColumn("anchor_no", F.when(F.col("abstractness") >= p.anchor_abstractness, anchored))
    missing = lambda c: F.col(c).isNull()
    wanted = F.array(
        F.when(missing("short_def"), F.struct(F.lit(0).alias("stage"), F.lit(0).alias("step"), F.lit("gloss").alias("task"))),
        F.when(missing("anchor") & (F.col("anchor_no") <= p.max_anchors), F.struct(F.lit(0).alias("stage"), F.lit(1).alias("step"), F.lit("anchor").alias("task"))),
        F.when(missing("why"), F.struct(F.lit(0).alias("stage"), F.lit(2).alias("step"), F.lit("why").alias("task"))),
        F.when(missing("analogy") & (F.col("rank") <= p.max_analogies), F.struct(F.lit(1).alias("stage"), F.lit(0).alias("step"), F.lit("analogy").alias("task"))),
    )
    rows = top.select("doc_id", "rank", F.col("concept_id").alias("subject_id"), F.col("canonical").alias("term"), "source", F.explode(F.array_compact(wanted)).alias("w")).select("doc_id", "w.stage", "rank", "w.step", "w.task", "subject_id", "term", "source")
    if figures is not None:
        rows = rows.unionByName(figures.select("doc_id", F.lit(2).alias("stage"), F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")).alias("rank"), F.lit(0).alias("step"), F.lit("figure").alias("task"), F.col("ord").cast("string").alias("subject_id"), F.col("number").alias("term"), F.col("subject").alias("source")))
    if long_sentences is not None:
        order = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(word_count("text")), "ord", "sent_ix"))
        cut = long_sentences.withColumn("rank", order).filter(F.col("rank") <= p.max_splits)
        rows = rows.unionByName(cut.select("doc_id", F.lit(3).alias("stage"), "rank", F.lit(0).alias("step"), F.lit("split").alias("task"), F.concat_ws(":", F.col("ord").cast("string"), F.col("sent_ix").cast("string")).alias("subject_id"), F.lit("").alias("term"), F.col("text").alias("source")))
    instruction = F.lit(None).cast("string")
    for task, template in INSTRUCTIONS.items():
        instruction = F.when(F.col("task") == task, F.format_string(template, "term", "source")).otherwise(instruction)
    position = F.row_number().over(Window.partitionBy("doc_id").orderBy("stage", "rank", "step", "subject_id"))
    return rows.withColumn("instruction", instruction).select("doc_id", position.alias("position"), "task", "subject_id", "instruction", request_digest(F.col("task"), F.col("instruction")).alias("digest"), "source")


def well_formed(task: Column, answer: Column) -> Column:
    """Does an answer (a map of strings) have its task's fields within their limits?"""
    ok = F.lit(False)
    for name, limits in LIMITS.items():
        held = F.lit(True)
        for field, most in limits.items():
            value = F.trim(F.try_element_at(answer, F.lit(field)))
            held = held & (F.coalesce(F.length(value), F.lit(0)) <= most) & (F.lit(True) if field in OPTIONAL else F.coalesce(value != "", F.lit(False)))
        if name == "anchor":
            held = held & (word_count(F.try_element_at(answer, F.lit("text"))) <= ANCHOR_WORDS)
        if name == "figure":
            held = held & F.coalesce(F.try_element_at(answer, F.lit("confidence")).cast("double").between(0, 1), F.lit(False))
        ok = F.when(task == name, held).otherwise(ok)
    return ok


def claims(answer: Column) -> Column:
    """What an answer claims: all its fields but how to say it and its notes."""
    fields = F.map_filter(answer, lambda k, v: ~k.isin("spoken", "evidence", "note", "confidence"))
    return F.array_join(F.map_values(fields), " ")


def outcomes(requests: DataFrame, answers: DataFrame, mode: str = "prefer") -> DataFrame:
    """Every request with what became of it: (.., answer, outcome, absence).

    ``answers``: (digest, answer map, error).  Modes: off tries nothing; assist and prefer use an answer
    only if it is well-formed and grounded, and record why not otherwise.
    """
    joined = requests.join(answers.select("digest", "answer", "error"), "digest", "left")
    formed = F.coalesce(well_formed(F.col("task"), F.col("answer")), F.lit(False)) | ((F.col("task") == "split") & F.col("answer").isNotNull())
    rows = joined.withColumn("formed", formed).withColumn("generated", F.when(F.col("formed"), claims(F.col("answer"))))
    bad = None
    for task, kinds in CHECKED.items():
        found = findings(rows.filter((F.col("task") == task) & F.col("formed")).select("doc_id", "position", "generated", "source"), kinds=kinds).filter("severity = 'error'").select("doc_id", "position")
        bad = found if bad is None else bad.unionByName(found)
    splits = rows.filter("task = 'split' AND formed").filter(F.size(verify_split(F.col("source"), F.col("generated"))) > 0).select("doc_id", "position")
    bad = bad.unionByName(splits).distinct().withColumn("ungrounded", F.lit(True))
    weak = (F.col("task") == "figure") & (F.coalesce(F.try_element_at("answer", F.lit("confidence")).cast("double"), F.lit(0.0)) < FIGURE_CONFIDENCE)
    out = rows.join(bad, ["doc_id", "position"], "left").withColumn("rejected", F.coalesce("ungrounded", F.lit(False)) | (F.col("formed") & weak))
    absence = F.when(F.lit(mode == "off"), F.lit("not configured")).when(F.col("error").isNotNull(), classify(F.col("error"))).when(F.col("answer").isNull(), F.lit("not configured")).when(~F.col("formed"), F.lit("refused")).when(F.col("rejected"), F.lit("rejected"))
    out = out.withColumn("absence", absence)
    return out.withColumn("outcome", F.when(F.col("absence").isNull(), F.lit("succeeded")).when(F.col("absence") == "rejected", F.lit("rejected")).otherwise(F.lit("degraded"))).withColumn("answer", F.when(F.col("absence").isNull(), F.col("answer"))).drop("formed", "generated", "ungrounded", "rejected")


def classify(error: Column) -> Column:
    """The absence that an error's kind stands for."""
    return F.when(error == "budget", F.lit("over budget")).when(error == "no provider", F.lit("not configured")).when(error == "refused", F.lit("refused")).otherwise(F.lit("unreachable"))


def absences(done: DataFrame) -> DataFrame:
    return done.filter("absence IS NOT NULL").groupBy("absence").agg(F.count("*").alias("n"))


def store(concepts: DataFrame, done: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """Concepts with what succeeded: short_def, anchor, why, analogy; a definition of the source stands in for a gloss."""
    field = {"short_def": ("gloss", "short_def"), "anchor": ("anchor", "text"), "why": ("why", "text"), "analogy": ("analogy", "text"), "analogy_limit": ("analogy", "limit")}
    best = done.filter("outcome = 'succeeded'").groupBy("doc_id", F.col("subject_id").alias("concept_id")).agg(*(F.max(F.when(F.col("task") == task, F.try_element_at("answer", F.lit(key)))).alias(f"new_{name}") for name, (task, key) in field.items()))
    out = concepts.join(best, ["doc_id", "concept_id"], "left")
    for name in field:
        out = out.withColumn(name, F.coalesce(F.col(name) if name in concepts.columns else F.lit(None).cast("string"), F.col(f"new_{name}"))).drop(f"new_{name}")
    if definitions is not None:
        out = out.join(definitions.select("doc_id", F.col("term").alias("canonical"), "definition"), ["doc_id", "canonical"], "left").withColumn("short_def", F.coalesce("short_def", "definition")).drop("definition")
    return out


def first_object(text: str | None) -> str | None:
    """The first balanced JSON object in a reply, as text, or None."""
    decoder, at = json.JSONDecoder(), (text or "").find("{")
    if at < 0:
        return None
    try:
        found, _ = decoder.raw_decode(text, at)  # type: ignore[arg-type]
    except ValueError:
        return None
    return json.dumps(found, ensure_ascii=False)


def extract_json(text: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(replies: pd.Series) -> pd.Series:
        return replies.map(first_object, na_action="ignore")

    return run(text)


def strict_schema(schema: dict) -> dict:
    """A JSON schema in which every object is closed and all its properties are required."""
    out = {k: strict_schema(v) if isinstance(v, dict) and k in ("items", "additionalProperties") else [strict_schema(x) if isinstance(x, dict) else x for x in v] if k in ("anyOf", "oneOf", "allOf") else v for k, v in schema.items()}
    for group in ("properties", "$defs"):
        if isinstance(schema.get(group), dict):
            out[group] = {k: strict_schema(v) for k, v in schema[group].items()}
    if schema.get("type") == "object" or "properties" in schema:
        out["additionalProperties"] = False
        if out.get("properties"):
            out["required"] = list(out["properties"])
    return out


def slugify(text: Column, most: int = 60) -> Column:
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most), "-+$", "")
