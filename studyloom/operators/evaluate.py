"""Metrics of a build, comparison with a baseline, cost arithmetic, speech timings and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.config import Profile
from studyloom.functions.text import word_count
from studyloom.operators.exposure import expanding, exposure_log, spaced
from studyloom.operators.lint_script import VALUE
from studyloom.operators.triage import retained
from studyloom.schema import GENERATED_TYPES

# Which way each metric may not move.
LOWER_IS_BETTER = ["lint_errors", "rules_skipped"]
HIGHER_IS_BETTER = ["gloss_coverage", "concepts_spaced", "intervals_expanding", "grounded", "values_kept", "words_retained", "prompts_per_minute"]
TOLERANCE = 0.02


def measure(blocks: DataFrame, beats: DataFrame, cards: DataFrame, concepts: DataFrame, violations: DataFrame, profile: Profile | None = None, rules_checked: int = 0, rules_skipped: int = 0, study: DataFrame | None = None) -> DataFrame:
    """One row of metrics per document."""
    profile = profile or Profile()
    live = beats.filter("NOT coalesce(cut, false)") if "cut" in beats.columns else beats
    length = F.col("est_seconds") + F.col("pause_after")
    owed = ~F.col("type").isin(GENERATED_TYPES) & (F.trim("text") != "")
    straight = F.sum(F.when(F.col("type").isin("exposition", "table", "figure", "equation", "answer") & (F.col("region") != "review"), F.col("est_seconds")).otherwise(0.0))
    plan = live.groupBy("doc_id").agg(
        (F.sum(length) / 60).alias("minutes_raw"), (F.greatest(straight * profile.duration_multiplier, F.lit(profile.duration_floor_seconds)) / 60).alias("budget_raw"), F.count_distinct("section_id").alias("sections"), F.count_distinct("section_id", "segment_ix").alias("segments"), F.count("*").alias("beats"),
        F.count_if(F.col("type") == "prompt").alias("prompts"), F.count_if(owed & (F.size("spans") > 0)).alias("with_spans"), F.count_if(owed).alias("owed"),
    )
    log = exposure_log(live)
    eps = spaced(log, profile.min_gap_seconds)
    by = eps.groupBy("doc_id", "concept_id").agg(F.count("*").alias("n"))
    met = log.select("doc_id", "concept_id").distinct().join(concepts.select("doc_id", "concept_id", "short_def"), ["doc_id", "concept_id"], "left").join(by, ["doc_id", "concept_id"], "left")
    spread = met.groupBy("doc_id").agg(F.avg(F.col("short_def").isNotNull().cast("double")).alias("gloss_raw"), F.avg((F.coalesce("n", F.lit(0)) > 1).cast("double")).alias("spaced_raw"), F.count_if(F.col("n") > 2).alias("recurring_concepts"))
    grow = expanding(eps).groupBy("doc_id").agg(F.avg(F.col("expanding").cast("double")).alias("expanding_raw"))
    gaps = eps.filter("gap IS NOT NULL").groupBy("doc_id").agg((F.percentile("gap", F.lit(0.5)) / 60).alias("gap_raw"))
    words = blocks.groupBy("doc_id").agg(F.sum(word_count("text")).alias("all_words")).join(retained(blocks).groupBy("doc_id").agg(F.sum(word_count("text")).alias("kept_words")), "doc_id", "left")
    lint = violations.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("lint_errors"), F.count_if(F.col("severity") == "warning").alias("lint_warnings"))
    out = plan.join(spread, "doc_id", "left").join(grow, "doc_id", "left").join(gaps, "doc_id", "left").join(words, "doc_id", "left").join(lint, "doc_id", "left").join(cards.groupBy("doc_id").agg(F.count("*").alias("cards")), "doc_id", "left")
    if study is not None:
        out = out.join(values_kept(live, study), "doc_id", "left")
    else:
        out = out.withColumn("values_raw", F.lit(1.0))
    return shown(out, rules_checked, rules_skipped)


def shown(out: DataFrame, rules_checked: int = 0, rules_skipped: int = 0) -> DataFrame:
    """The metrics of documents out of their sums, counts and words."""
    ratio = lambda c, other: F.bround(F.coalesce(c, F.lit(other)), 3)
    return out.select(
        "doc_id", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("lint_errors", "lint_warnings")), F.lit(rules_checked).alias("rules_checked"), F.lit(rules_skipped).alias("rules_skipped"),
        F.bround("minutes_raw", 2).alias("minutes"), F.bround("budget_raw", 2).alias("budget_minutes"), ratio(F.col("minutes_raw") / F.col("budget_raw"), 0.0).alias("budget_used"), "sections", "segments", "beats", F.coalesce("cards", F.lit(0)).alias("cards"),
        ratio(F.col("gloss_raw"), 0.0).alias("gloss_coverage"), ratio(F.col("spaced_raw"), 0.0).alias("concepts_spaced"), ratio(F.col("expanding_raw"), 1.0).alias("intervals_expanding"), F.coalesce("recurring_concepts", F.lit(0)).alias("recurring_concepts"), F.bround(F.coalesce("gap_raw", F.lit(0.0)), 2).alias("median_gap_minutes"),
        ratio(F.when(F.col("owed") > 0, F.col("with_spans") / F.col("owed")), 1.0).alias("grounded"), ratio(F.col("values_raw"), 1.0).alias("values_kept"), ratio(F.when(F.col("all_words") > 0, F.col("kept_words") / F.col("all_words")), 0.0).alias("words_retained"), ratio(F.when(F.col("minutes_raw") > 0, F.col("prompts") / F.col("minutes_raw")), 0.0).alias("prompts_per_minute"),
    )


def values_kept(beats: DataFrame, study: DataFrame) -> DataFrame:
    values = beats.filter("written_text IS NOT NULL").select("doc_id", F.explode(F.regexp_extract_all("written_text", F.lit(VALUE), 0)).alias("v")).distinct()
    return values.join(study, "doc_id", "left").groupBy("doc_id").agg(F.avg(F.contains(F.coalesce("study", F.lit("")), F.trim("v")).cast("double")).alias("values_raw"))


def regressions(current: DataFrame, baseline: DataFrame, key: str = "document", tolerance: float = TOLERANCE) -> DataFrame:
    """(document, metric, was, now): what got worse, and documents that no longer build."""
    names = [c for c in [*LOWER_IS_BETTER, "rules_checked", *HIGHER_IS_BETTER, "budget_used"] if c in current.columns and c in baseline.columns]
    side = lambda df, alias: df.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names))).alias("m")).select(key, "m.metric", F.col("m.value").alias(alias))
    both = side(baseline, "was").join(side(current, "now"), [key, "metric"], "left")
    worse = (
        (F.col("metric").isin(LOWER_IS_BETTER) & (F.col("now") > F.col("was")))
        | ((F.col("metric") == "rules_checked") & (F.col("now") < F.col("was")))
        | (F.col("metric").isin(HIGHER_IS_BETTER) & (F.col("now") < F.col("was") - tolerance))
        | ((F.col("metric") == "budget_used") & (F.col("now") > F.greatest(F.lit(1.0), F.col("was")) + tolerance))
    )
    gone = baseline.select(key).distinct().join(current.select(key).distinct(), key, "left_anti").select(key, F.lit("no longer builds").alias("metric"), F.lit(None).cast("double").alias("was"), F.lit(None).cast("double").alias("now"))
    return both.filter(worse).unionByName(gone)


def changes(first: DataFrame, second: DataFrame, key: str = "document") -> DataFrame:
    """Metrics that differ between two builds, the largest relative move first."""
    names = [c for c, t in first.dtypes if c != key and t in ("double", "bigint", "int") and c in second.columns]
    side = lambda df, alias: df.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names))).alias("m")).select(key, "m.metric", F.col("m.value").alias(alias))
    both = side(first, "first").join(side(second, "second"), [key, "metric"]).filter("first <> second")
    return both.withColumn("move", F.abs(F.col("second") - F.col("first")) / F.greatest(F.abs("first"), F.abs("second"))).orderBy(F.desc("move"), key, "metric")


# ---------------------------------------------------------------- model cost

#: Calls in one task of a ledger, and most pieces of a run (larger pieces beyond).
LEDGER_ROWS, LEDGER_PIECES = 100_000, 1000
CHARS_PER_TOKEN, CACHED_SHARE, BATCH_SHARE, IMAGE_TOKENS = 3.6, 0.1, 0.5, 500


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.length(text) / CHARS_PER_TOKEN, 0).cast("int"))


def image_tokens(width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), F.greatest(F.lit(1), F.floor(width * height / 750))).otherwise(F.lit(IMAGE_TOKENS)).cast("int")


def estimate_cost(requests: DataFrame, input_price: float, output_price: float, batch: bool = False) -> DataFrame:
    """``requests`` (request_id, system, document, instruction, max_tokens[, images]) with ``dollars``.

    The first request of a (system, document) pair pays the whole prefix, later ones the cached share.
    Prices are per million tokens and belong to the caller.
    """
    first = F.row_number().over(Window.partitionBy("system", "document").orderBy("request_id")) == 1
    prefix = (estimate_tokens(F.col("system")) + estimate_tokens(F.col("document"))) * F.when(first, F.lit(1.0)).otherwise(F.lit(CACHED_SHARE))
    suffix = estimate_tokens(F.col("instruction")) + (F.col("image_tokens") if "image_tokens" in requests.columns else F.lit(0))
    dollars = (prefix * input_price + suffix * input_price + F.floor(F.col("max_tokens") / 2) * output_price) / 1e6
    return requests.withColumn("dollars", dollars * (BATCH_SHARE if batch else 1.0))


def ledger(responses: DataFrame, input_price: float, output_price: float, cap: float | None = None) -> DataFrame:
    """``responses`` (call_no, input_tokens, cached_tokens, output_tokens) with ``spent`` so far and whether the cap allowed the call.

    The run is cut into pieces by ranges of call_no; each sums by itself, from what all earlier pieces spent.
    """
    fresh = F.greatest(F.lit(0), F.col("input_tokens") - F.col("cached_tokens"))
    cost = (fresh * input_price + F.col("cached_tokens") * input_price * CACHED_SHARE + F.col("output_tokens") * output_price) / 1e6
    pieces = min(LEDGER_PIECES, -(-responses.count() // LEDGER_ROWS))
    bounds = responses.agg(F.percentile_approx("call_no", [k / pieces for k in range(1, pieces)])).first()[0] if pieces > 1 else None
    piece = F.size(F.filter(F.lit(sorted(set(bounds))), lambda b: b < F.col("call_no"))) if bounds else F.lit(0)
    priced = responses.withColumn("cost", cost).withColumn("_piece", F.when(F.col("call_no").isNull(), 0).otherwise(piece))
    earlier = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # at most LEDGER_PIECES rows
    before = priced.groupBy("_piece").agg(F.sum("cost").alias("_cost")).select("_piece", F.coalesce(F.sum("_cost").over(earlier), F.lit(0.0)).alias("_before"))
    own = F.sum("cost").over(Window.partitionBy("_piece").orderBy("call_no").rowsBetween(Window.unboundedPreceding, 0))
    out = priced.withColumn("_own", own).join(F.broadcast(before), "_piece").withColumn("spent", F.col("_before") + F.col("_own")).drop("_piece", "_own", "_before")
    return out.withColumn("allowed", F.lit(True) if cap is None else F.col("spent") <= cap)


def replay_cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with the answer that a cache or fixture table holds for their digest; ``hit`` says whether it does."""
    return requests.join(cache.select("digest", "answer"), "digest", "left").withColumn("hit", F.col("answer").isNotNull())


# ---------------------------------------------------------------- speech and sinks


def speech_timings(beats: DataFrame, wpm: float = 150.0) -> DataFrame:
    """What a silent engine would take: starts, lengths and the drift from the plan's estimate."""
    spoken = word_count("text") * 60.0 / wpm
    w = Window.partitionBy("doc_id").orderBy("seq")
    before = lambda c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = beats.filter(F.trim("text") != "").withColumn("seconds", spoken)
    return rows.withColumn("start", before(F.col("seconds") + F.col("pause_after"))).withColumn("planned", before(F.col("est_seconds") + F.col("pause_after"))).withColumn("drift", F.col("start") - F.col("planned")).select("doc_id", "seq", "beat_id", "start", "seconds", "pause_after", "drift")


def to_synthesize(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks whose content key is not in the cache."""
    return chunks.join(cache.select("key"), "key", "left_anti")


def render_audio(beats: DataFrame) -> DataFrame:
    """(doc_id, audio): what is said, beats apart by a blank line."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda b: b["text"])
    return beats.filter((F.trim("text") != "") & ~F.coalesce("cut", F.lit(False)) if "cut" in beats.columns else F.trim("text") != "").groupBy("doc_id").agg(F.array_join(said, "\n\n").alias("audio"))


def render_study(beats: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, study): the written track with exact wording, and an appendix of every equation."""
    line = F.concat(F.when(F.col("type") == "position", F.lit("## ")).when(F.col("generated"), F.lit("> ")).otherwise(F.lit("")), F.coalesce("written_text", "text"))
    body = beats.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda b: b["line"]), "\n\n").alias("body"))
    maths = blocks.filter("kind = 'equation'").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda b: F.concat(F.lit("$$"), b["text"], F.lit("$$"))), "\n\n").alias("maths"))
    return body.join(maths, "doc_id", "left").select("doc_id", F.concat("body", F.when(F.col("maths").isNotNull(), F.concat(F.lit("\n\n## Equations\n\n"), "maths")).otherwise(F.lit(""))).alias("study"))


def render_cards(cards: DataFrame) -> DataFrame:
    """(doc_id, json): the cards of a document as one JSON array."""
    return cards.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("card_id", "subject", "prompt", "answer", "prompt_type", "section_id")))).alias("json"))


def render_manifest(beats: DataFrame, cards: DataFrame) -> DataFrame:
    facts = beats.groupBy("doc_id").agg(F.count("*").alias("beats"), F.count_distinct("section_id").alias("sections"), F.round(F.sum(F.col("est_seconds") + F.col("pause_after")) / 60, 2).alias("minutes"))
    joined = facts.join(cards.groupBy("doc_id").agg(F.count("*").alias("cards")), "doc_id", "left").fillna({"cards": 0})
    return joined.select("doc_id", F.to_json(F.struct("beats", "sections", "minutes", "cards")).alias("json"))


def study_log(beats: DataFrame) -> DataFrame:
    """``rollup`` of planned seconds by document, section and segment."""
    return beats.rollup("doc_id", "section_id", "segment_ix").agg(F.sum("est_seconds").alias("est_seconds"), F.count("*").alias("beats"))
