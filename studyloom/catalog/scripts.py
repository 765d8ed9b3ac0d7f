"""Queries over programmes: timelines, spacing, budgets, review logs, script rules, metrics, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from studyloom.catalog import sql as q
from studyloom.catalog.text import lines
from studyloom.config import Profile
from studyloom.functions.text import word_count
from studyloom.operators import elaborate, evaluate, exposure, lint_script
from studyloom.operators.triage import triage
from studyloom.plans.pipeline import build, metrics
from studyloom.session import table

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):  # noqa: ANN201
    def add(function):  # noqa: ANN001, ANN202
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return add


# A script out of conversations: a user's turn asks, an assistant's turn answers, a system's turn is a transition.
_SCRIPT = f"""b AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS seq, turn, text,
 CASE role WHEN 'user' THEN 'prompt' WHEN 'assistant' THEN CASE WHEN turn % 5 = 3 THEN 'exposition' ELSE 'answer' END ELSE 'transition' END AS type,
 's' || (turn // 3) AS section_id, turn // 2 AS segment_ix, ['c' || (length(text) % 5), 'c' || (length(text) % 3)] AS concept_ids, {q.word_count('text')} * 60.0::DOUBLE / 155.0::DOUBLE AS est_seconds, (turn % 4)::DOUBLE + 1.5::DOUBLE AS pause_after FROM conversations)"""


def script(spark: SparkSession, d: str) -> DataFrame:
    """Beats made of the conversations' turns."""
    rows = table(spark, d, "conversations")
    seq = (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1).cast("int")
    kind = F.when(F.col("role") == "user", "prompt").when((F.col("role") == "assistant") & (F.col("turn") % 5 == 3), "exposition").when(F.col("role") == "assistant", "answer").otherwise("transition")
    cid = lambda m: F.concat(F.lit("c"), (F.length("text") % m).cast("string"))
    return rows.select(
        F.col("conv_id").alias("doc_id"), seq.alias("seq"), F.lit("body").alias("region"), F.concat(F.lit("s"), F.expr("cast(turn div 3 as string)")).alias("section_id"), F.expr("cast(turn div 2 as int)").alias("segment_ix"),
        F.concat_ws("-", F.lit("b"), "conv_id", seq).alias("beat_id"), kind.alias("type"), "text", F.array(cid(5), cid(3)).alias("concept_ids"), (word_count("text") * 60.0 / 155.0).alias("est_seconds"), (F.col("turn") % 4 + 1.5).cast("double").alias("pause_after"),
        (F.col("role") == "system").alias("generated"), F.concat_ws("-", F.lit("k"), "conv_id", F.expr("turn div 2")).alias("card_id"), F.array(F.struct(F.lit(0).alias("block"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"))).alias("spans"), F.col("text").alias("written_text"), "turn",
    )


@query(f"WITH {_SCRIPT} SELECT doc_id, seq::INT AS seq, round(coalesce(sum(est_seconds + pause_after) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS at_seconds FROM b")
def timeline(spark: SparkSession, d: str) -> DataFrame:
    return exposure.timeline(script(spark, d)).select("doc_id", "seq", F.round("at_seconds", 6).alias("at_seconds"))


_TIMED = ", t AS (SELECT *, coalesce(sum(est_seconds + pause_after) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_seconds FROM b)"
_LOG = f"""{_TIMED}, x AS (SELECT *, CASE type WHEN 'exposition' THEN 'statement' WHEN 'prompt' THEN 'prompt' END AS form, unnest(concept_ids) AS concept_id FROM t WHERE type IN ('exposition', 'prompt')),
 log AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, concept_id, type ORDER BY seq) AS nth FROM x) WHERE type <> 'exposition' OR nth = 1)"""


@query(f"WITH {_SCRIPT}{_LOG} SELECT doc_id, concept_id, seq::INT AS seq, form, section_id, round(at_seconds, 6) AS at_seconds FROM log")
def exposure_first(spark: SparkSession, d: str) -> DataFrame:
    """The exposure log: of expositions only the first of a concept counts."""
    return exposure.exposure_log(script(spark, d)).select("doc_id", "concept_id", "seq", "form", "section_id", F.round("at_seconds", 6).alias("at_seconds"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, epoch(ts) AS z, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT user_id, event_type, z, k, z AS kept, true AS keep FROM e WHERE k = 1
 UNION ALL SELECT e.user_id, e.event_type, e.z, e.k, CASE WHEN e.z - w.kept < 86400 THEN w.kept ELSE e.z END, e.z - w.kept >= 86400 FROM w JOIN e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.k = w.k + 1)
SELECT user_id, event_type, count(*) AS episodes, round(min(gap), 3) AS least_gap FROM (SELECT *, z - lag(z) OVER (PARTITION BY user_id, event_type ORDER BY k) AS gap FROM w WHERE keep) GROUP BY user_id, event_type""")
def episode_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """Events folded into episodes anchored on the last kept one (a day apart)."""
    rows = table(spark, d, "events").select("user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "event_id")
    eps = exposure.episodes(rows, ["user_id", "event_type"], at="at", section=None, window=86400.0)
    return eps.groupBy("user_id", "event_type").agg(F.count("*").alias("episodes"), F.round(F.min("gap"), 3).alias("least_gap"))


@query(f"""WITH RECURSIVE {_SCRIPT}, p AS (SELECT doc_id, seq, est_seconds + pause_after AS len FROM b),
w AS (SELECT doc_id, seq, len, len AS run, 0 AS segment FROM p WHERE seq = 0
 UNION ALL SELECT p.doc_id, p.seq, p.len, CASE WHEN w.run + p.len > 120 THEN p.len ELSE w.run + p.len END, CASE WHEN w.run + p.len > 120 THEN w.segment + 1 ELSE w.segment END FROM w JOIN p ON p.doc_id = w.doc_id AND p.seq = w.seq + 1)
SELECT doc_id, (max(segment) + 1)::INT AS segments, round(max(run), 6) AS longest FROM w GROUP BY doc_id""")
def segment_pack(spark: SparkSession, d: str) -> DataFrame:
    """Beats packed into segments by a sum that starts anew at the limit (a fold over an ordered array)."""
    rows = script(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", (F.col("est_seconds") + F.col("pause_after")).alias("len")))).alias("b"))
    start = F.struct(F.lit(0.0).alias("run"), F.lit(0).alias("segment"), F.lit(0.0).alias("longest"))

    def step(acc, x):  # noqa: ANN001, ANN202
        full = (acc["run"] > 0) & (acc["run"] + x["len"] > 120)
        run = F.when(full, x["len"]).otherwise(acc["run"] + x["len"])
        return F.struct(run.alias("run"), F.when(full, acc["segment"] + 1).otherwise(acc["segment"]).alias("segment"), F.greatest(acc["longest"], run).alias("longest"))

    out = F.aggregate("b", start, step)
    return rows.select("doc_id", (out["segment"] + 1).alias("segments"), F.round(out["longest"], 6).alias("longest"))


@query()
def spacing_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Callbacks of concepts (event types per user) on shared slots (days)."""
    ev = table(spark, d, "events")
    origin = F.lit("2024-01-01").cast("timestamp")
    at = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(origin)) / 6e7
    requests = ev.groupBy(F.col("user_id").alias("doc_id"), F.col("event_type").alias("concept_id")).agg(F.min(at).alias("first_at"), (F.count("*") % 4 + 1).cast("int").alias("repetitions"), F.lit(None).cast("string").alias("section_id"), (F.max("value") / 1000).alias("priority"))
    slots = ev.select(F.col("user_id").alias("doc_id"), F.floor(at / 720).alias("day")).distinct().select("doc_id", F.concat(F.lit("d"), F.col("day").cast("string")).alias("slot_id"), ((F.col("day") + 1) * 720.0).alias("at_seconds"), F.lit(None).cast("string").alias("section_id"), F.lit(2).alias("capacity"))
    return exposure.schedule(requests, slots)


@query(f"""WITH b AS (SELECT l_orderkey AS doc_id, l_suppkey AS section_id, l_linenumber AS seq, l_partkey, (['analogy', 'elaboration', 'figure', 'emphasis', 'callback', 'exposition', 'answer'])[l_partkey % 7 + 1] AS type, l_quantity AS len FROM lineitem),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq, section_id, l_partkey) AS n, list_position({[*exposure.DROP_ORDER]}, type) AS type_rank FROM b),
s AS (SELECT doc_id, section_id, sum(len) AS section_seconds, min(n) AS section_first FROM u GROUP BY ALL), tot AS (SELECT doc_id, sum(len) AS total, 0.7::DOUBLE * sum(len) AS budget FROM u GROUP BY doc_id),
r AS (SELECT u.*, total, budget, coalesce(sum(len) OVER (PARTITION BY u.doc_id, coalesce(type_rank, 0) > 0 ORDER BY type_rank, section_seconds, section_first, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u JOIN s USING (doc_id, section_id) JOIN tot USING (doc_id))
SELECT doc_id, count(*) FILTER (coalesce(type_rank, 0) > 0 AND before < total - budget) AS n_cut, coalesce(sum(len) FILTER (coalesce(type_rank, 0) > 0 AND before < total - budget), 0)::DOUBLE AS cut_seconds FROM r GROUP BY doc_id""")
def budget_cut(spark: SparkSession, d: str) -> DataFrame:
    """The budget cut on orders: lines are beats, suppliers sections, quantities seconds."""
    li = table(spark, d, "lineitem")
    kinds = F.array(*map(F.lit, [*exposure.DROP_ORDER, "exposition", "answer"]))
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey"))
    beats = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("section_id"), n.alias("seq"), F.get(kinds, (F.col("l_partkey") % 7).cast("int")).alias("type"), F.col("l_quantity").alias("est_seconds"), F.lit(0.0).alias("pause_after"))
    budgets = beats.groupBy("doc_id").agg((0.7 * F.sum("est_seconds")).alias("budget_seconds"))
    out = exposure.enforce_budget(beats, budgets)
    return out.groupBy("doc_id").agg(F.count_if("cut").alias("n_cut"), F.sum(F.when(F.col("cut"), F.col("est_seconds")).otherwise(0.0)).alias("cut_seconds"))


@query()
def interleave_review(spark: SparkSession, d: str) -> DataFrame:
    cards = table(spark, d, "events").select((F.col("user_id") % 10).alias("doc_id"), F.col("event_id").cast("string").alias("card_id"), F.col("event_type").alias("section_id"))
    return exposure.interleave(cards).groupBy("doc_id").agg(F.count("*").alias("cards"), F.max("position").alias("last"))


_REPLAY = """r AS (SELECT user_id, event_id, ts, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 a AS (SELECT *, max(CASE WHEN rn = 1 OR NOT ok THEN rn END) OVER (PARTITION BY user_id ORDER BY rn) AS anc FROM r),
 i AS (SELECT *, least(power(2.5::DOUBLE, rn - anc), 365.0::DOUBLE) AS days FROM a)"""


def review_log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("card_id"), "event_id", F.col("ts").alias("at"), (F.col("event_type") != "error").alias("correct"))


@query(f"WITH {_REPLAY} SELECT user_id AS card_id, event_id, round(days, 6) AS interval_days FROM i")
def review_replay(spark: SparkSession, d: str) -> DataFrame:
    return exposure.replay(review_log(spark, d), tie="event_id").select("card_id", "event_id", F.round("interval_days", 6).alias("interval_days"))


@query(f"WITH {_REPLAY} SELECT user_id AS card_id, count(*) AS reviews, count(*) FILTER (ok) AS correct, max(ts) AS last_at, round(arg_max(days, rn), 6) AS interval_days, max(ts) + to_microseconds((round(arg_max(days, rn) * 86400, 6) * 1000000)::BIGINT) AS due_at FROM i GROUP BY user_id")
def review_state(spark: SparkSession, d: str) -> DataFrame:
    return exposure.card_state(review_log(spark, d), tie="event_id").withColumn("interval_days", F.round("interval_days", 6))


@query(f"""WITH {_REPLAY}, s AS (SELECT user_id AS card_id, max(ts) + to_microseconds((round(arg_max(days, rn) * 86400, 6) * 1000000)::BIGINT) AS due_at FROM i GROUP BY user_id),
c AS (SELECT c_custkey AS card_id, c_acctbal AS difficulty FROM customer), j AS (SELECT c.*, due_at FROM c LEFT JOIN s USING (card_id)),
due AS (SELECT card_id, 'due' AS why, due_at, difficulty FROM j WHERE due_at <= TIMESTAMP '2024-02-15' ORDER BY due_at, card_id LIMIT 12), fresh AS (SELECT card_id, 'new' AS why, due_at, difficulty FROM j WHERE due_at IS NULL ORDER BY difficulty DESC, card_id LIMIT 5)
SELECT card_id, why, position::INT AS position FROM (SELECT card_id, why, row_number() OVER (ORDER BY CASE WHEN why = 'due' THEN 0 ELSE 1 END, due_at ASC NULLS LAST, difficulty DESC, card_id) AS position FROM (SELECT * FROM due UNION ALL SELECT * FROM fresh)) WHERE position <= 12""")
def review_select(spark: SparkSession, d: str) -> DataFrame:
    """A study session of at most twelve cards: due ones, then the hardest new ones (limits are the feature)."""
    cards = table(spark, d, "customer").select(F.col("c_custkey").alias("card_id"), F.col("c_acctbal").alias("difficulty"))
    state = exposure.card_state(review_log(spark, d), tie="event_id")
    return exposure.select_session(cards, state, F.lit("2024-02-15").cast("timestamp"), 12, 5).select("card_id", "why", "position")


@query(f"WITH {_REPLAY}, s AS (SELECT user_id, count(*) AS reviews, count(*) FILTER (ok) AS correct, max(ts) + to_microseconds((round(arg_max(days, rn) * 86400, 6) * 1000000)::BIGINT) AS due_at FROM i GROUP BY user_id) SELECT sum(reviews)::BIGINT AS answers, count(*) AS cards_started, round_even(sum(correct)::DOUBLE / sum(reviews)::DOUBLE, 2) AS accuracy, count(*) FILTER (due_at <= TIMESTAMP '2024-02-15') AS due FROM s")
def review_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return exposure.review_status(review_log(spark, d), F.lit("2024-02-15").cast("timestamp"), tie="event_id")


# ---------------------------------------------------------------- script rules


def _violations(rule: str, message: str, source: str, excerpt: str = "substr(text, 1, 160)", severity: str = "'error'", beat: str = "'b-' || doc_id || '-' || seq") -> str:
    return f"SELECT doc_id, '{rule}' AS rule, {message} AS message, {excerpt} AS excerpt, {severity} AS severity, {beat} AS beat_id {source}"


@query(f"WITH {_SCRIPT}, n AS (SELECT *, lead(type) OVER (PARTITION BY doc_id, section_id ORDER BY seq) AS following FROM b) " + _violations("RET-01", "'prompt has no answer beat'", "FROM n WHERE type = 'prompt' AND following IS DISTINCT FROM 'answer'"))
def lint_script_ret_01(spark: SparkSession, d: str) -> DataFrame:
    return lint_script.prompt_has_answer(script(spark, d))


@query(f"WITH {_SCRIPT} " + _violations("PAU-01", "'pause under the minimum'", "FROM b WHERE type = 'prompt' AND pause_after < 3"))
def lint_script_pau_01(spark: SparkSession, d: str) -> DataFrame:
    return lint_script.prompt_has_pause(script(spark, d), Profile())


@query(f"""WITH {_SCRIPT}, s AS (SELECT doc_id, section_id, segment_ix, sum(est_seconds + pause_after) AS s, segment_ix = max(segment_ix) OVER (PARTITION BY doc_id, section_id) AS last FROM b GROUP BY doc_id, section_id, segment_ix),
m AS (SELECT *, CASE WHEN s > 120 THEN 'segment over the hard maximum' WHEN s > 90 THEN 'segment over the target' WHEN s < 45 AND NOT last THEN 'segment too short' END AS m FROM s) """ + _violations("SEG-01", "m", "FROM m WHERE m IS NOT NULL", "section_id || '/' || segment_ix", "CASE WHEN s > 120 THEN 'error' ELSE 'warning' END", "NULL::VARCHAR"))
def lint_script_seg_01(spark: SparkSession, d: str) -> DataFrame:
    return lint_script.segment_duration(script(spark, d), Profile())


@query(f"""WITH {_SCRIPT}, t AS (SELECT doc_id, section_id, segment_ix, seq, unnest(concept_ids) AS c FROM b WHERE type IN ('exposition', 'answer')),
f AS (SELECT * FROM (SELECT *, first_value(section_id || '/' || segment_ix) OVER (PARTITION BY doc_id, c ORDER BY seq) AS first FROM t) WHERE first = section_id || '/' || segment_ix),
w AS (SELECT doc_id, section_id, segment_ix, max(n) AS worst FROM (SELECT doc_id, section_id, segment_ix, seq, count(DISTINCT c) AS n FROM f GROUP BY ALL) GROUP BY ALL),
n AS (SELECT doc_id, section_id, segment_ix, count(DISTINCT c) AS n FROM f GROUP BY ALL HAVING count(DISTINCT c) > 1) """ + _violations("SEG-03", "n || ' new terms in a segment'", "FROM n JOIN w USING (doc_id, section_id, segment_ix)", "section_id || '/' || segment_ix", "CASE WHEN worst > 1 THEN 'warning' ELSE 'error' END", "NULL::VARCHAR"))
def lint_script_seg_03(spark: SparkSession, d: str) -> DataFrame:
    from dataclasses import replace

    return lint_script.new_terms(script(spark, d), replace(Profile(), max_new_terms=1))


@query(f"WITH {_SCRIPT}, a AS (SELECT *, flatten(list(concept_ids) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) AS ahead FROM b) " + _violations("SEG-04", "'announces what the next beats are not about'", "FROM a WHERE type = 'transition' AND NOT list_has_any(concept_ids, coalesce(ahead, []))", severity="'warning'"))
def lint_script_seg_04(spark: SparkSession, d: str) -> DataFrame:
    return lint_script.true_transitions(script(spark, d))


@query(f"WITH {_SCRIPT} " + _violations("TTS-04", "'beat does not end on a sentence boundary'", "FROM b WHERE trim(text) <> '' AND NOT regexp_matches(trim(text), '[.?!:;—]$')"))
def lint_script_tts_04(spark: SparkSession, d: str) -> DataFrame:
    return lint_script.whole_sentences(script(spark, d))


@query(f"WITH {_SCRIPT}, s AS (SELECT doc_id, section_id, bool_or(type = 'recap') AS recap, bool_or(type = 'prompt') AS prompt FROM b GROUP BY ALL) " + _violations("STR-06", "'section has no recap'", "FROM s WHERE NOT recap", "section_id", beat="NULL::VARCHAR") + " UNION ALL " + _violations("STR-06", "'section has no retrieval prompt'", "FROM s WHERE NOT prompt", "section_id", beat="NULL::VARCHAR"))
def lint_script_str_06(spark: SparkSession, d: str) -> DataFrame:
    return lint_script.section_ends(script(spark, d))


def script_cards(spark: SparkSession, d: str) -> DataFrame:
    return script(spark, d).filter("type = 'answer'").select("doc_id", F.col("beat_id").alias("card_id"), F.col("text").alias("answer"), "section_id")


@query(f"WITH {_SCRIPT}, c AS (SELECT doc_id, trim(regexp_replace(text, '(?i)^Here''s the answer about .*?\\.\\s*', '')) AS core FROM b WHERE type = 'answer'), n AS (SELECT doc_id, core, count(*) AS n FROM c WHERE core <> '' GROUP BY ALL HAVING count(*) > 1) " + _violations("RET-06", "'one sentence answers ' || n || ' questions'", "FROM n", "substr(core, 1, 160)", "'warning'", "NULL::VARCHAR"))
def lint_script_ret_06(spark: SparkSession, d: str) -> DataFrame:
    return lint_script.distinct_answers(script_cards(spark, d))


@query("""WITH c AS (SELECT c_nationkey::BIGINT AS doc_id, c_name AS canonical, lower(c_mktsegment) AS key FROM customer) SELECT doc_id, 'IMG-02' AS rule, 'concepts share an anchor' AS message, key AS excerpt, 'error' AS severity, NULL::VARCHAR AS beat_id FROM c GROUP BY doc_id, key HAVING count(DISTINCT canonical) > 1""")
def lint_script_img_02(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_nationkey").cast("bigint").alias("doc_id"), F.col("c_name").alias("canonical"), F.col("c_mktsegment").alias("anchor"))
    return lint_script.unique_anchors(rows)


@query()
def lint_script_spc_01(spark: SparkSession, d: str) -> DataFrame:
    return lint_script.minimum_gap(script(spark, d), Profile())


@query()
def lint_script_rep_01(spark: SparkSession, d: str) -> DataFrame:
    return lint_script.repeats_not_verbatim(script(spark, d))


@query()
def lint_script_all(spark: SparkSession, d: str) -> DataFrame:
    """All script rules at once on the conversations' script: counts per rule."""
    found, _ = lint_script.lint_script(script(spark, d), Profile(), cards=script_cards(spark, d))
    return lint_script.counts(found)


_FURN = " UNION ALL ".join(f"SELECT conv_id, {q.quoted(label)} AS label, regexp_extract(audio, {q.quoted(p)}) AS hit FROM a" for p, label in lint_script.FURNITURE)


@query(f"WITH a AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, role, text) || CASE WHEN conv_id % 4 = 0 THEN ' We thank the reviewers. Keywords: none' ELSE '' END AS audio FROM conversations GROUP BY conv_id), h AS ({_FURN}) SELECT conv_id AS doc_id, label || ' reached the audio track' AS message, hit AS excerpt FROM h WHERE hit <> ''")
def lint_artefact_coh_01(spark: SparkSession, d: str) -> DataFrame:
    """Furniture that reached the audio track (a fourth of the conversations gets some)."""
    audio = evaluate.render_audio(script(spark, d)).withColumn("audio", F.concat("audio", F.when(F.col("doc_id") % 4 == 0, F.lit(" We thank the reviewers. Keywords: none")).otherwise(F.lit(""))))
    return lint_script.drop_list(triage(lines(spark, d)).withColumn("doc_id", -F.col("doc_id") - 1), audio).select("doc_id", "message", "excerpt")


# ---------------------------------------------------------------- whole builds


def _build(spark: SparkSession, d: str, *only: str):  # noqa: ANN202
    return build(lines(spark, d), cleaned=True, only=only, keep=False)


@query()
def plan_documents(spark: SparkSession, d: str) -> DataFrame:
    """Programmes of all documents: beats and planned seconds by type."""
    beats = _build(spark, d, "beats").beats
    return beats.groupBy("doc_id", "region", "type").agg(F.count("*").alias("beats"), F.round(F.sum("est_seconds"), 3).alias("seconds"), F.count_if("cut").alias("cut"))


@query()
def plan_cards(spark: SparkSession, d: str) -> DataFrame:
    return _build(spark, d, "cards").cards.groupBy("doc_id", "prompt_type").agg(F.count("*").alias("cards"))


@query()
def build_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The metrics of every document's build."""
    return metrics(lines(spark, d), cleaned=True)


_METRICS = f"""m AS (SELECT 'doc' || ((doc_id + doc_id % 2) // 2) AS document, doc_id, round_even(count(*) FILTER (type = 'prompt') / 10.0::DOUBLE, 3) AS prompts_per_minute, count(*) FILTER (pause_after < 3) AS lint_errors, round_even(avg(CASE WHEN type = 'answer' THEN 1.0 ELSE 0.0 END), 3) AS grounded FROM b GROUP BY doc_id)"""


@query(f"""WITH {_SCRIPT}, {_METRICS}, now AS (SELECT document, prompts_per_minute, lint_errors::DOUBLE AS lint_errors, grounded FROM m WHERE doc_id % 2 = 0), was AS (SELECT document, prompts_per_minute, lint_errors::DOUBLE AS lint_errors, grounded FROM m WHERE doc_id % 2 = 1),
w AS (UNPIVOT was ON prompts_per_minute, lint_errors, grounded INTO NAME metric VALUE was), n AS (UNPIVOT now ON prompts_per_minute, lint_errors, grounded INTO NAME metric VALUE now)
SELECT document, metric, was, now FROM w LEFT JOIN n USING (document, metric) WHERE (metric = 'lint_errors' AND now > was) OR (metric <> 'lint_errors' AND now < was - 0.02::DOUBLE)
UNION ALL SELECT document, 'no longer builds', NULL, NULL FROM was WHERE document NOT IN (SELECT document FROM now)""")
def metrics_regression(spark: SparkSession, d: str) -> DataFrame:
    """What got worse from the odd conversations to the even ones, each odd one against the next even one; the last has none and is gone."""
    m = script(spark, d).groupBy("doc_id").agg(F.bround(F.count_if(F.col("type") == "prompt") / 10.0, 3).alias("prompts_per_minute"), F.count_if(F.col("pause_after") < 3).cast("double").alias("lint_errors"), F.bround(F.avg((F.col("type") == "answer").cast("double")), 3).alias("grounded")).withColumn("document", F.concat(F.lit("doc"), F.expr("(doc_id + doc_id % 2) div 2").cast("string")))
    return evaluate.regressions(m.filter("doc_id % 2 = 0").drop("doc_id"), m.filter("doc_id % 2 = 1").drop("doc_id"))


_TOK = "greatest(1, round_even(length({t}) / 3.6::DOUBLE, 0))"


@query(f"""WITH r AS (SELECT doc_id, repeat('s', 200) AS system, source AS document, coalesce(text, '') AS instruction, row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1 AS first FROM documents)
SELECT doc_id AS request_id, round(((({_TOK.format(t='system')} + {_TOK.format(t='document')}) * CASE WHEN first THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END) * 3.0::DOUBLE + {_TOK.format(t='instruction')} * 3.0::DOUBLE + 128 * 15.0::DOUBLE) / 1000000, 9) AS dollars FROM r""")
def model_cost(spark: SparkSession, d: str) -> DataFrame:
    """What a request per document would cost, the prefix cached after the first of a source."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("request_id"), F.lit("s" * 200).alias("system"), F.col("source").alias("document"), F.coalesce("text", F.lit("")).alias("instruction"), F.lit(256).alias("max_tokens"))
    return evaluate.estimate_cost(rows, 3.0, 15.0).select("request_id", F.round("dollars", 9).alias("dollars"))


@query("""WITH r AS (SELECT o_orderkey AS call_no, floor(o_totalprice)::BIGINT % 5000 AS i, (o_custkey % 900) AS c, o_orderkey % 300 AS o FROM orders),
s AS (SELECT call_no, sum((greatest(0, i - c) * 3.0::DOUBLE + c * 0.3::DOUBLE + o * 15.0::DOUBLE) / 1000000) OVER (ORDER BY call_no ROWS UNBOUNDED PRECEDING) AS spent FROM r) SELECT call_no, round(spent, 7) AS spent, spent <= 2.0 AS allowed FROM s""")
def cost_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Running spend of calls against a cap (one run's calls are one ordered ledger)."""
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("call_no"), (F.floor("o_totalprice").cast("bigint") % 5000).alias("input_tokens"), (F.col("o_custkey") % 900).alias("cached_tokens"), (F.col("o_orderkey") % 300).alias("output_tokens"))
    return evaluate.ledger(rows, 3.0, 15.0, cap=2.0).select("call_no", F.round("spent", 7).alias("spent"), "allowed")


@query(f"""WITH {_SCRIPT}, s AS (SELECT *, {q.word_count('text')} * 60.0::DOUBLE / 150.0::DOUBLE AS seconds FROM b WHERE trim(text) <> ''), w AS (SELECT *, coalesce(sum(seconds + pause_after) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, coalesce(sum(est_seconds + pause_after) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS planned FROM s)
SELECT doc_id, seq::INT AS seq, round(start, 6) AS start, round(seconds, 6) AS seconds, round(start - planned, 6) AS drift FROM w""")
def speech_timings(spark: SparkSession, d: str) -> DataFrame:
    t = evaluate.speech_timings(script(spark, d))
    return t.select("doc_id", "seq", *(F.round(c, 6).alias(c) for c in ("start", "seconds", "drift")))


@query("SELECT conv_id AS doc_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn, role, text)) AS digest FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def render_audio(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.render_audio(script(spark, d)).select("doc_id", F.md5("audio").alias("digest"))


@query()
def render_study(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.render_study(script(spark, d), lines(spark, d)).select("doc_id", F.length("study").alias("n_chars"))


@query()
def render_cards(spark: SparkSession, d: str) -> DataFrame:
    cards = script_cards(spark, d).withColumns({"subject": F.col("section_id"), "prompt": F.lit("?"), "prompt_type": F.lit("recall")})
    return evaluate.render_cards(cards)


@query(f"WITH {_SCRIPT} SELECT doc_id, section_id, segment_ix::INT AS segment_ix, round(sum(est_seconds), 6) AS est_seconds, count(*) AS beats FROM b GROUP BY ROLLUP (doc_id, section_id, segment_ix)")
def duration_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Planned seconds by document, section and segment with all totals."""
    return evaluate.study_log(script(spark, d)).withColumn("est_seconds", F.round("est_seconds", 6))


@query("SELECT sha256(text) AS key, count(*) AS chunks FROM conversations WHERE sha256(text) NOT IN (SELECT sha256(text) FROM conversations WHERE conv_id % 2 = 0) GROUP BY ALL")
def speech_cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that an incremental render would have to synthesise (even conversations are cached)."""
    chunks = table(spark, d, "conversations").select("conv_id", F.sha2("text", 256).alias("key"))
    return evaluate.to_synthesize(chunks, chunks.filter("conv_id % 2 = 0").select("key").distinct()).groupBy("key").agg(F.count("*").alias("chunks"))


@query("SELECT d.doc_id, sha256(coalesce(d.text, '')) AS digest, l.quality::VARCHAR AS answer, l.quality IS NOT NULL AS hit FROM documents d LEFT JOIN labels l USING (doc_id)")
def cached_answers(spark: SparkSession, d: str) -> DataFrame:
    """Requests answered from a fixtures table by digest."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    cache = docs.join(table(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("digest_doc"), "digest", F.col("quality").cast("string").alias("answer"))
    keyed = docs.withColumn("digest", F.concat_ws("-", F.col("doc_id").cast("string"), "digest"))
    out = evaluate.replay_cached(keyed, cache.select(F.concat_ws("-", F.col("digest_doc").cast("string"), "digest").alias("digest"), "answer"))
    return out.select("doc_id", F.substring_index("digest", "-", -1).alias("digest"), "answer", "hit")


# ---------------------------------------------------------------- elaboration


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests for the customers' segments as concepts of nations, supported by their names."""
    c = table(spark, d, "customer")
    doc = F.col("c_nationkey").cast("bigint").alias("doc_id")
    found = c.select(doc, F.col("c_name").alias("concept_id"), F.col("c_name").alias("canonical"), (F.abs("c_acctbal") / 10000).alias("budget"), (F.col("c_custkey") % 10 / 10.0).alias("abstractness"), F.when(F.col("c_custkey") % 3 == 0, "known").alias("short_def"), *(F.lit(None).cast("string").alias(x) for x in ("anchor", "why", "analogy")))
    support = c.select(doc, F.col("c_name").alias("concept_id"), F.lit(1).alias("rank"), F.concat_ws(" ", "c_mktsegment", F.col("c_acctbal").cast("string")).alias("text"))
    return elaborate.plan_requests(found, support)


@query("""WITH c AS (SELECT c_nationkey::BIGINT AS doc_id, c_name, c_custkey, abs(c_acctbal) / 10000 AS budget, (c_custkey % 10) / 10.0::DOUBLE AS ab FROM customer),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY budget DESC, c_name) AS rank FROM c WHERE budget > 0) WHERE rank <= 12),
a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ab >= 0.5 ORDER BY rank) AS anchor_no FROM r),
w AS (SELECT doc_id, c_name, rank, 0 AS stage, 0 AS step, 'gloss' AS task FROM a WHERE c_custkey % 3 <> 0 UNION ALL SELECT doc_id, c_name, rank, 0, 1, 'anchor' FROM a WHERE ab >= 0.5 AND anchor_no <= 4
 UNION ALL SELECT doc_id, c_name, rank, 0, 2, 'why' FROM a UNION ALL SELECT doc_id, c_name, rank, 1, 0, 'analogy' FROM a WHERE rank <= 3)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY stage, rank, step, c_name)::INT AS position, task, c_name AS subject_id FROM w""")
def request_plan(spark: SparkSession, d: str) -> DataFrame:
    """The requests that an elaboration run would make, in order and within its caps (the caps are the feature)."""
    return _requests(spark, d).select("doc_id", "position", "task", "subject_id")


@query()
def request_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Answers from a fixtures table: used, refused, rejected or missing."""
    req = _requests(spark, d)
    fields = F.create_map(F.lit("short_def"), F.lit("a short one"), F.lit("long_def"), F.lit("a longer one"), F.lit("text"), F.when(F.col("position") % 5 == 0, F.lit("It has 987 of them.")).otherwise(F.lit("It is like a pan.")), F.lit("limit"), F.when(F.col("position") % 4 == 0, F.lit("")).otherwise(F.lit("Pans are hot.")))
    answers = req.filter("position % 6 <> 0").select("digest", fields.alias("answer"), F.when(F.col("position") % 11 == 0, F.lit("timeout")).alias("error")).dropDuplicates(["digest"])
    return elaborate.outcomes(req, answers).groupBy("task", "outcome", "absence").agg(F.count("*").alias("n"))


@query(r"""SELECT s_suppkey, regexp_replace(substr(regexp_replace(regexp_replace(translate(lower(s_name || ' Été n°' || s_suppkey), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '', 'g') AS slug FROM supplier""")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", elaborate.slugify(F.concat("s_name", F.lit(" Été n°"), F.col("s_suppkey").cast("string"))).alias("slug"))


@query()
def reply_objects(spark: SparkSession, d: str) -> DataFrame:
    """The first JSON object in wrapped replies (event properties inside prose)."""
    ev = table(spark, d, "events").select("event_id", F.concat(F.lit("Sure! ```json "), F.coalesce("props", F.lit("")), F.lit(" ``` done }")).alias("reply"))
    return ev.select(elaborate.extract_json("reply").alias("found")).groupBy(F.col("found").isNull().alias("missing")).agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT doc_id, lang AS a, source AS b FROM documents) SELECT a, count(*) AS n FROM s GROUP BY a")
def signal_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts by source of evidence (languages stand in)."""
    return table(spark, d, "documents").groupBy(F.col("lang").alias("a")).agg(F.count("*").alias("n"))
