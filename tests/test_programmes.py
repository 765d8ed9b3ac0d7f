"""Properties of scheduling, folds and the planner; rules that fire and rules that do not; streaming."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from studyloom.config import Profile
from studyloom.operators import clean, concepts, evaluate, exposure, grounding, lint_script, lint_text, triage
from studyloom.plans.planner import Beat, Plan
from studyloom.schema import BLOCKS
from studyloom.sources import adapters, artefacts, layout
from studyloom.streaming import review

REQUESTS = st.lists(st.builds(dict, concept_id=st.sampled_from("abcdefgh"), first_at=st.floats(0, 600), repetitions=st.integers(1, 5), section_id=st.none(), priority=st.floats(0, 1)), max_size=8, unique_by=lambda r: r["concept_id"])
SLOTS = st.integers(1, 40).map(lambda n: [{"slot_id": f"s{k}", "at_seconds": 60.0 * k, "section_id": None} for k in range(n)])


@settings(max_examples=60, deadline=None)
@given(REQUESTS, SLOTS)
def test_schedules_keep_their_gaps_and_capacity(requests, slots):
    placed, unplaced, following = exposure.schedule_one(requests, slots)
    used: dict = {}
    for p in placed:
        used[p["slot_id"]] = used.get(p["slot_id"], 0) + 1
    assert all(n <= 2 for n in used.values())
    for r in requests:
        times = [r["first_at"], *(p["at_seconds"] for p in placed if p["concept_id"] == r["concept_id"])]
        gaps = [b - a for a, b in zip(times, times[1:], strict=False)]
        assert all(g >= 180 for g in gaps) and gaps == sorted(gaps)
        assert len(gaps) + unplaced.get(r["concept_id"], 0) == r["repetitions"] - 1
    assert set(following) == {r["concept_id"] for r in requests}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.integers(0, 99).map(str)), unique=True, max_size=20))
def test_interleaving_only_collides_where_it_must(items):
    order, collisions = exposure.interleave_one(items)
    assert sorted(order) == sorted(items)
    same = sum(a[0] == b[0] for a, b in zip(order, order[1:], strict=False))
    most = max((sum(i[0] == s for i in items) for s in "abcd"), default=0)
    assert same == collisions and collisions >= 2 * most - len(items) - 1


@settings(max_examples=15, deadline=None)
@given(answers=st.lists(st.booleans(), min_size=1, max_size=12))
def test_the_closed_form_is_the_replay(spark, answers):
    rows = spark.createDataFrame([("c", k, bool(a)) for k, a in enumerate(answers)], "card_id string, at int, correct boolean")
    got = [r.interval_days for r in exposure.replay(rows).orderBy("at").collect()]
    state, want = 0.0, []
    for a in answers:
        state = min(state * 2.5, 365.0) if a and state > 0 else 1.0
        want.append(state)
    assert got == pytest.approx(want)


def test_episodes_are_anchored_on_the_kept_exposure(spark):
    rows = spark.createDataFrame([(1, "c", float(t), s) for t, s in [(0, "a"), (50, "a"), (100, "b"), (130, "b"), (400, "b")]], "doc_id int, concept_id string, at_seconds double, section_id string")
    eps = exposure.episodes(rows, ["doc_id", "concept_id"], min_gap=180.0).orderBy("episode").collect()
    assert [(e.at_seconds, e.gap) for e in eps] == [(0.0, None), (100.0, 100.0), (400.0, 300.0)]


def blocks(spark, rows):
    return spark.createDataFrame([(1, k, kind, "unknown", level, page, None, text) for k, (kind, level, page, text) in enumerate(rows)], BLOCKS)


def test_cleaning_passes(spark):
    rows = [("heading", 1, 1, "2.1 One\n2.2 Two"), ("paragraph", None, 1, "inter-\nphase and self-\nlimiting ﬁlm"), ("paragraph", None, 1, "It goes on with"), ("page_artifact", None, 1, "Journal 7"), ("paragraph", None, 2, "more of the same. A full paragraph ends here now."), ("paragraph", None, 2, "The text has a body of forty characters or more. Acknowledgements We thank all.")]
    out = clean.dehyphenate(clean.split_stacked_headings(blocks(spark, rows)))
    assert [r.text for r in out.orderBy("ord").collect()][:3] == ["2.1 One", "2.2 Two", "interphase and self-limiting film"]
    merged = clean.merge_continuations(out).orderBy("ord").collect()
    assert any(r.text.startswith("It goes on with more of the same.") and r.spans_pages for r in merged)
    cut = clean.split_back_matter(blocks(spark, rows[-1:])).orderBy("ord").collect()
    assert [r.text for r in cut] == ["The text has a body of forty characters or more.", "Acknowledgements We thank all."]


def test_sections_roles_and_unheaded_references(spark):
    rows = [("heading", 1, None, "Introduction"), ("paragraph", None, None, "Some prose of the section."), ("heading", 2, None, "A detail"), ("paragraph", None, None, "More prose."), ("heading", 1, None, "2 Methods"), ("paragraph", None, None, "We did it.")]
    rows += [("paragraph", None, None, f"[{k}] A. Author, A title, 20{k + 10}.") for k in range(1, 7)]
    got = clean.assign_sections(blocks(spark, rows)).orderBy("ord").collect()
    assert [r.role for r in got[:6]] == ["introduction", "introduction", "introduction", "introduction", "methods", "methods"]
    assert got[3].section == 2 and got[2].parent == 0 and {(r.role, r.kind) for r in got[6:]} == {("references", "reference")}


def test_captions_and_their_figures(spark):
    box = lambda y0, y1: (0.0, y0, 100.0, y1)
    rows = [(1, 0, "figure", "unknown", None, 1, box(0.0, 40.0), ""), (1, 1, "figure", "unknown", None, 1, box(45.0, 90.0), ""), (1, 2, "caption", "unknown", None, 1, box(95.0, 110.0), "Figure 1. Chain reactions in cells. (a) one (b) two. Copyright 2023"), (1, 3, "figure", "unknown", None, 1, box(300.0, 340.0), ""), (1, 4, "paragraph", "unknown", None, 1, box(400.0, 420.0), "As Figure 1 shows, it is so.")]
    got = clean.link_figures(spark.createDataFrame(rows, BLOCKS)).collect()
    assert len(got) == 1 and got[0].members == [0, 1] and got[0].subject == "Chain reactions in cells" and got[0].references == [4] and got[0].region.y1 == 90.0


def test_triage_order(spark):
    rows = [("reference", None, None, "x"), ("paragraph", None, None, "All rights reserved."), ("paragraph", None, None, "Volt ampere ohm farad henry tesla weber siemens joule"), ("table", None, None, "x1 y2"), ("paragraph", None, None, "stray label"), ("paragraph", None, None, "This is the argument of the paper.")]
    got = triage.triage(blocks(spark, rows)).orderBy("ord").collect()
    assert [r.triage.action for r in got] == ["drop", "drop", "drop", "transform", "drop", "keep"] and got[1].triage.reason == "copyright"


def test_reading_order_of_two_columns(spark):
    rows = [(1, 1, n, t, (x0, y0, x1, y0 + 10), 10.0, 10.0, 0.0) for n, (t, x0, y0, x1) in enumerate([("R1", 110.0, 20.0, 200.0), ("L1", 0.0, 20.0, 90.0), ("Top", 0.0, 0.0, 200.0), ("L2", 0.0, 40.0, 90.0), ("R2", 110.0, 40.0, 200.0)])]
    raw = spark.createDataFrame(rows, "doc_id int, page int, n int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, font_mode double, font_max double, bold_ratio double")
    assert [r.text for r in layout.reading_order(raw).orderBy("ord").collect()] == ["Top", "L1", "L2", "R1", "R2"]


def test_grounding(spark):
    rows = spark.createDataFrame([(1, "It rises by 1,234 units, said Curie in 1903", "it falls by 1234 units"), (2, "The value is 0,0837", "a value of 0.0837 was seen"), (3, "No claim", None)], "k int, generated string, source string")
    got = {(r.k, r.kind, r.value) for r in grounding.findings(rows).collect()}
    assert (1, "direction", "rises") in got and (1, "year", "1903") in got and (1, "name", "Curie") in got and not any(k in (2, 3) for k, _, _ in got) and (1, "number", "1234") not in got
    assert {r.k: r.verified for r in grounding.verdicts(rows, ["k"]).collect()} == {1: False, 2: True, 3: True}


def test_text_rules_fire(spark):
    text = "Cost 5 % (of all), e.g. [3] see the figure above. TR is bad. " + "word " * 40
    found = {r.rule for r in lint_text.lint(spark.createDataFrame([(1, text), (2, "All is well here.")], "doc_id int, text string")).collect() if r.doc_id == 1}
    assert found == set(lint_text.RULES)
    assert lint_text.lint(spark.createDataFrame([(2, "All is well here.")], "doc_id int, text string")).count() == 0


SENTENCES = [f"The {w} of the cell is a thing that changes because the layer grows in step {k}." for k, w in enumerate(["drift term", "gain term", "loss term"] * 8)]


def plan(profile=None):
    rows = [{"section_id": f"s{k // 8}", "section_title": f"{k // 8 + 1} Part", "ord": k, "sent_ix": 0, "char_start": 0, "char_end": len(t), "text": t, "concept_ids": [t.split()[1]]} for k, t in enumerate(SENTENCES)]
    about = [{"concept_id": c, "canonical": f"{c} term", "short_def": "a slow change" if c == "drift" else None, "difficulty": 0.8, "importance": 0.9, "budget": 0.72, "first_ord": 0} for c in ("drift", "gain", "loss")]
    support = [{"concept_id": r["concept_ids"][0], "rank": k, "definitional": k == 0, "causal": True, **{x: r[x] for x in ("ord", "sent_ix", "char_start", "char_end", "text")}} for k, r in enumerate(rows)]
    return Plan(profile or Profile(min_gap_seconds=30.0), "a paper", rows, about, support)


def test_plans_obey_the_rules(spark):
    from studyloom.plans.planner import PLAN_BEATS, PLAN_CARDS

    p = plan()
    beats = spark.createDataFrame(p.rows(1), PLAN_BEATS).filter("NOT cut")
    cards = spark.createDataFrame([(1, c.id, c.concept, c.subject, c.prompt, c.answer, c.kind, c.difficulty, c.section) for c in p.cards], PLAN_CARDS)
    found, skipped = lint_script.lint_script(beats, Profile(min_gap_seconds=30.0), cards=cards)
    errors = [r for r in found.collect() if r.severity == "error" and r.rule not in ("SPC-01", "SEG-01", "REP-01", "STR-07")]
    assert not errors, errors
    assert "IMG-02" in skipped and {r.type for r in beats.collect()} >= {"orientation", "prequestion", "exposition", "prompt", "answer", "recap", "review", "position"}
    blocks_ = triage.triage(blocks(spark, [("paragraph", None, None, t) for t in SENTENCES]))
    about = spark.createDataFrame([(1, c, "d") for c in ("drift", "gain", "loss")], "doc_id bigint, concept_id string, short_def string")
    m = evaluate.measure(blocks_, beats, cards, about, found).collect()[0]
    assert m.grounded == 1.0 and m.gloss_coverage == 1.0 and m.cards == len(p.cards) and 0 < m.budget_used <= 1.0


def test_budget_cuts_in_order(spark):
    rows = [(1, k, "s", t, 10.0, 0.0) for k, t in enumerate(["exposition", "callback", "analogy", "figure", "answer"])]
    beats = spark.createDataFrame(rows, "doc_id int, seq int, section_id string, type string, est_seconds double, pause_after double")
    out = exposure.enforce_budget(beats, spark.createDataFrame([(1, 35.0)], "doc_id int, budget_seconds double"))
    assert {r.type for r in out.filter("cut").collect()} == {"analogy", "figure"}


def test_script_rules_fire(spark):
    rows = [
        (1, 0, "body", "s", 0, "b0", "prompt", "What?", "w", ["c"], 5.0, 0.5, True, "k", []),
        (1, 1, "body", "s", 0, "b1", "exposition", "This means the layer grows", "w", ["c"], 200.0, 0.0, False, None, []),
        (1, 2, "body", "s", 0, "b2", "anchor", "A pan of 5 eggs.", "a pan", ["c"], 5.0, 0.0, True, None, []),
        (1, 3, "body", "s", 0, "b3", "table", "Five and six.", "w", ["c"], 5.0, 0.0, False, None, [(0, 0, 1)]),
        (1, 4, "body", "s", 0, "b4", "figure", "Something is seen.", "w", ["c"], 5.0, 0.0, False, None, [(0, 0, 1)]),
        (1, 5, "body", "s", 0, "b5", "transition", "Next, x.", "w", ["zz"], 5.0, 0.0, True, None, []),
    ]
    schema = "doc_id bigint, seq int, region string, section_id string, segment_ix int, beat_id string, type string, text string, written_text string, concept_ids array<string>, est_seconds double, pause_after double, generated boolean, card_id string, spans array<struct<block:int,char_start:int,char_end:int>>"
    beats = spark.createDataFrame(rows, schema)
    cards = spark.createDataFrame([(1, "k", "Here's the answer about a. Same."), (1, "k2", "Here's the answer about b. Same.")], "doc_id bigint, card_id string, answer string").withColumn("section_id", F.lit("s"))
    about = spark.createDataFrame([(1, "a", "one picture", "like a pan", ""), (1, "b", "One  picture", None, None)], "doc_id bigint, canonical string, anchor string, analogy string, analogy_limit string")
    source = triage.triage(blocks(spark, [("equation", None, None, "E = mc^2"), ("reference", None, None, "One two three four five six seven eight nine.")]).withColumn("role", F.lit("references")))
    audio = spark.createDataFrame([(1, "So: one two three four five six seven eight nine. We thank you.")], "doc_id bigint, audio string")
    study = spark.createDataFrame([(1, "nothing")], "doc_id bigint, study string")
    found, skipped = lint_script.lint_script(beats, Profile(), cards=cards, concepts=about, blocks=source, audio=audio, study=study)
    fired = {r.rule for r in found.collect()}
    assert not skipped and fired >= {"STR-06", "SEG-01", "RET-01", "PAU-01", "GRD-01", "VOI-02", "PAU-02", "GRD-03", "IMG-02", "ANA-01", "TTS-04", "SENT-02", "TBL-02", "FIG-01", "RET-06", "SEG-04", "COH-01", "MTH-04", "STR-02"}, fired


def test_redundant_phrases_fold(spark):
    rows = spark.createDataFrame([(1, "battery loss", 10), (1, "fast battery loss", 9), (1, "cell wall", 10), (1, "thin cell wall", 2)], "doc_id bigint, phrase string, mentions bigint")
    assert {r.phrase for r in concepts.drop_redundant(rows).collect()} == {"fast battery loss", "cell wall"}


def test_artefacts_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    artefacts.write_artefact(rows, f"{tmp_path}/a")
    assert artefacts.read_artefact(spark, f"{tmp_path}/a", "doc_id int, text string").collect() == rows.collect()
    rows.withColumn("schema_version", F.lit(9)).write.json(f"{tmp_path}/b")
    with pytest.raises(Exception, match="schema version 9"):
        artefacts.read_artefact(spark, f"{tmp_path}/b", "doc_id int, text string").collect()
    (tmp_path / "paper.md").write_text("# A\n\nText of the paper.")
    loaded = adapters.load(spark, f"{tmp_path}/paper.md")
    assert [r.kind for r in loaded.orderBy("ord").collect()] == ["heading", "paragraph"] and adapters.titles(loaded).first().title == "A"


def test_the_stream_ends_where_the_batch_does(spark, tmp_path):
    lines = [{"card_id": f"c{k % 3}", "correct": k % 4 != 0, "at": f"2024-01-{k + 1:02d}T00:00:00Z"} for k in range(12)]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text("\n".join(map(json.dumps, lines[:6])) + "\nnot json\n")
    (tmp_path / "log" / "b.json").write_text("\n".join(map(json.dumps, lines[6:])))
    query = review.card_states(review.read_log(spark, f"{tmp_path}/log")).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    streamed = {r.card_id: (r.reviews, r.correct, round(r.interval_days, 6)) for r in spark.table("states").orderBy("reviews").collect()}
    batch = {r.card_id: (r.reviews, r.correct, round(r.interval_days, 6)) for r in exposure.card_state(artefacts.read_review_log(spark, f"{tmp_path}/log")).collect()}
    assert streamed == batch


def test_a_ledger_sums_by_pieces_of_the_run(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "LEDGER_ROWS", 50, raising=False)
    rows = [(k * k % 1009 * 3 + k * 5000, k % 700, k % 90, k % 40) for k in range(1000)]
    frame = spark.createDataFrame(rows, "call_no bigint, input_tokens bigint, cached_tokens bigint, output_tokens bigint")
    out = evaluate.ledger(frame, 3.0, 15.0, cap=0.5)
    spent, want = 0.0, {}
    for n, i, c, o in sorted(rows):
        spent += (max(0, i - c) * 3.0 + c * 0.3 + o * 15.0) / 1e6
        want[n] = spent
    got = {r.call_no: r for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[n].spent - want[n]) < 1e-9 and got[n].allowed == (got[n].spent <= 0.5) for n in want)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    pieces = out.select("spent", F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("spent").alias("n"), F.max("spent")).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out.columns == [*frame.columns, "cost", "spent", "allowed"] and max(r["n"] for r in pieces) < len(rows)


def test_segments_are_resized_once_everything_is_in_them():
    profile = Profile(min_gap_seconds=30.0, segment_min=20.0, segment_max=30.0, segment_hard_max=40.0)
    p = plan(profile)
    said = [b.written for _, _, segments in p.sections for seg in segments for b in seg if b.type == "exposition"]
    assert sorted(" ".join(said).split()) == sorted(" ".join(SENTENCES).split())  # nothing is lost
    for _, _, segments in p.sections:
        for seg in segments:
            assert all(seg[k + 1].type == "answer" for k, b in enumerate(seg) if b.type == "prompt")
        for seg, after in zip(segments, segments[1:], strict=False):
            assert seg[-1].type == "transition" and after[0].type not in ("answer", "prequestion_close", "transition")


def test_long_segments_are_cut_at_allowed_places():
    p = plan()
    p.p = Profile(segment_min=1.0, segment_max=20.0, segment_hard_max=25.0)
    say = lambda kind, seconds, text="Text.": Beat(kind, text, seconds)
    beats = [say("position", 2), say("exposition", 12), say("exposition", 12), say("prompt", 5), say("answer", 5), say("recap", 4)]
    parts = p.cut(beats, "Part")
    assert [[b.type for b in part] for part in parts] == [["position", "exposition", "transition"], ["exposition", "transition"], ["prompt", "answer", "recap"]] or [[b.type for b in part] for part in parts] == [["position", "exposition", "transition"], ["exposition", "prompt", "answer", "transition"], ["recap"]]
    assert p.cut([say("prompt", 30), say("answer", 30)], "Part")[0][0].type == "prompt"  # no allowed place: left whole
    assert len(p.cut([say("prompt", 30), say("answer", 30)], "Part")) == 1


def test_a_build_attaches_the_definition_a_document_states(spark):
    from studyloom.plans.pipeline import build

    text = "Spectral drift is defined as the slow change of a baseline signal.\n" + "\n".join(f"We saw spectral drift again in the {n} run because the lamp was warm." for n in ("early", "later", "final", "longest"))
    blocks = clean.line_blocks(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"))
    b = build(blocks, cleaned=True)
    row = b.concepts.filter("lower(canonical) = 'spectral drift'").collect()[0]
    assert row.short_def == "the slow change of a baseline signal" and row.def_at.char_start == 0
    glosses = b.beats.filter("type = 'gloss'").collect()
    assert any("slow change" in g.text and g.spans[0].block == row.def_at.ord for g in glosses)


def test_candidates_repeat_the_steps_of_phrases_without_a_join(spark):
    words = "cell wall stress and the fast battery loss state of charge copyright notice a x ray Cell Wall".split()
    texts = [(d, "\n".join(" ".join(words[(d * 7 + i * k + i * i) % len(words)] for i in range(90)) + ". Cell wall stress, cell Wall stress; Fast battery loss." for k in range(1, 6))) for d in range(12)]
    rows = [*texts, (12, None), (13, ""), (14, "\u212aelvin scale. " * 5 + "kelvin scale."), (None, "cell wall " * 9)]
    blocks = clean.line_blocks(spark.createDataFrame(rows, "doc_id long, text string"))
    s = blocks.select("doc_id", "ord", F.posexplode(F.split("text", r"\. ")).alias("sent_ix", "text"))
    kept = concepts.drop_redundant(concepts.repeated_phrases(s))
    homes = concepts.phrase_hits(s, kept.select("doc_id", "phrase", F.col("phrase").alias("item"))).groupBy("doc_id", F.col("item").alias("phrase")).agg(F.min("ord").alias("ord"))
    stepwise = kept.join(homes, ["doc_id", "phrase"]).join(concepts.surface_forms(s, kept), ["doc_id", "phrase"])
    got = {tuple(r) for r in concepts.repetitions(s).collect()}
    assert got == {(r.doc_id, r.phrase, r.mentions, r.ord, r.canonical) for r in stepwise.collect()} and len(got) > 20
    assert "Join" not in concepts.candidates(s)._jdf.queryExecution().executedPlan().toString()  # joins of all n-grams filled the disk


def test_a_build_holds_what_the_operators_say_and_deals_texts_once(spark):
    from studyloom.plans.pipeline import build

    lines = ["Spectral drift is defined as the slow change of a baseline signal.", "We show that spectral drift, 3.5 mV in all, causes the cell wall stress because the lamp was warm.", "The solid electrolyte interphase (SEI) may grow, i.e., the cell wall stress rises.", "Here η is the coulombic efficiency of 12 cells and the cell wall stress."]
    texts = [(d, "\n".join(lines[(d + i * i) % 4] + (" Notably, spectral drift and the SEI met cell wall stress again." if i % 3 else " Stop.") for i in range(5 + d))) for d in range(6)]
    blocks = clean.line_blocks(spark.createDataFrame([*texts, (7, None), (8, "")], "doc_id long, text string").repartition("doc_id"))
    b = build(blocks, cleaned=True)
    s = clean.split_sentences(triage.retained(triage.triage(blocks)))
    named = concepts.candidates(s)
    found = concepts.mentions(s, named)
    ids = {(r.doc_id, r.concept_id): r for r in concepts.score(concepts.raw_signals(s, named, found)).collect()}
    got = {(r.doc_id, r.concept_id): r for r in b.concepts.collect()}
    assert got.keys() == ids.keys() and len(got) > 12
    for k, r in got.items():
        assert (r.canonical, r.signals) == (ids[k].canonical, ids[k].signals)
        assert (r.difficulty, r.importance, r.budget) == pytest.approx((ids[k].difficulty, ids[k].importance, ids[k].budget), abs=1e-12)
    best = concepts.distinct_supports(concepts.supports(s, found))
    key = lambda r: (r.doc_id, r.concept_id, r.rank, r.ord, r.sent_ix, r.text, round(r.score, 9), r.definitional, r.causal)
    assert {key(r) for r in b.supports.collect()} == {key(r) for r in best.collect()}
    terms = named.filter("short_def IS NULL").select("doc_id", F.col("canonical").alias("term"))
    stated = {(r.doc_id, r.term): r.definition for r in concepts.find_definitions(s, terms).collect()}
    glosses = {(r.doc_id, r.concept_id): r.short_def or stated.get((r.doc_id, r.canonical)) for r in named.collect()}
    assert {k: r.short_def for k, r in got.items()} == glosses
    assert {(r.doc_id, r.ord, r.sent_ix, c) for r in b.sentences.collect() for c in r.concept_ids} == {(r.doc_id, r.ord, r.sent_ix, r.concept_id) for r in found.collect()}
    lean = build(blocks, cleaned=True, only=("beats",), keep=False).beats
    assert lean.count() == b.beats.count() and "Join" not in lean._jdf.queryExecution().executedPlan().toString()


def test_hints_let_through_whatever_the_spoken_patterns_find():
    from studyloom.functions import spoken

    said = ["E.G. this", "e. g. that", "I. e. so", "\u0130.e. so", "\u0131.e. so", "CF. it", "VS it", "v\u017f. it", "ETC.", "Approx. 3", "CA. 5", "Fig\u017f. 2", "EQS. 1", "REF. 4", "tab. 1", "NO. 7", "WRT x", "w.R.t. x", "AND/OR"]
    for text in said:
        found = [hint for pattern, _, hint in spoken._SHORT_FORMS if pattern.search(text)]
        assert found and all(hint in spoken.folded(text) for hint in found)
    for word in [*spoken.POINTED_AT, *spoken.CITED_TOO, *spoken.THINGS]:
        assert any(hint in spoken.folded(word.upper()) for hint in spoken._POINTS_HINTS)
    assert spoken.speak("It is 3.5 mV, e.g. (see Fig. 2) x_2 - a [b] in Li1.5Mn.") == "It is three point five millivolts, for example X sub two — a b in lithium one point five manganese."


def test_cards_alone_are_laid_out_without_joins_or_checkpoints(spark):
    from studyloom.plans.pipeline import build

    blocks = clean.line_blocks(spark.createDataFrame([(1, "The cell wall is warm today and stays so.\n" * 5)], "doc_id long, text string").repartition("doc_id"))
    cards = build(blocks, cleaned=True, only=("cards",), keep=False).cards
    shape = cards._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in shape and shape.count("MapInArrow") == 1 and cards.count() > 0


def scripts_at_random():
    """(beats, cards, concepts) of documents that break every rule now and then."""
    import random

    pick = random.Random(7)
    types = "prequestion prequestion_close preload exposition exposition gloss anchor analogy elaboration prompt answer recap callback callback transition figure table equation review".split()
    starts = ["This is", "It follows that", "The former was", "THESE ſhow", "Their own", "Such\tgoes", "that was", "It was", "État is", "they becameé"]
    more = ["the wall grew in 1999 and 2012", "the wall shrank by 1,250.50 or 0,5 or 3·10 or 007", "here's a way to picture it", "the table has a row", "a chart, in the written notes", "an axis. A diagram", "rises higher than Kelvin scale", "falls lower in 2012, 12019 or 1250.5.", "İ and more words so that eight of them stand in a row", "plot", "x" * 130]
    ends = [".", "", ":", ". ", "\n", " ", ";\u0085", "!", "—\r\n", "? "]
    said = lambda: f"{pick.choice(starts)} {' '.join(pick.sample(more, pick.randint(1, 3)))}{pick.choice(ends)}" if pick.random() < 0.95 else pick.choice(["", "  ", "\t"])
    beats, cards, concepts = [], [], []
    for doc in range(60):
        ids = [f"c{k}" for k in range(5)]
        concepts += [(doc, c, pick.choice([None, "a thing"])) for c in ids[:4]]
        n = pick.choice([0, 0, 1, 3, 6])
        cards += [(doc, f"k{k}", ids[k % 5], "s", "p", pick.choice(["", "Here's the answer about it. One.", "HERE'S THE ANSWER ABOUT a b. One.", "Here’s", "One.", " One. "]), "recall", 0.5, pick.choice([None, "s0", "s1"])) for k in range(n)]
        texts = [said() for _ in range(12)]
        places = sorted((r, s, g) for r, s, g in ((pick.choice([0, 1, 1, 1, 1, 2]), pick.randint(0, 2), pick.randint(0, 2)) for _ in range(pick.choice([1, 5, 40, 70]))))
        for seq, (r, s, g) in enumerate(places):
            region = ("opening", "body", "review")[r]
            spans = pick.choice([None, [], [(1, 0, 5)]])
            beats.append((doc, seq, region, f"s{s}" if r == 1 else None, g if r == 1 else None, f"t{doc}_{seq}", pick.choice(types), pick.choice(texts), pick.choice([None, " ", "", *texts]), pick.sample(ids, pick.randint(0, 4)), pick.choice([0.1, 7.3, 22.7, 44.9, 130.0]), pick.choice([0.0, 1.2, 2.0, 3.0]), pick.random() < 0.5, pick.choice([None, "k0", "k1", "k2", "k7"]), spans, pick.random() < (1.0 if doc == 3 else 0.1)))
    return beats, cards, concepts


def test_a_document_measured_alone_is_measured_as_by_the_operators(spark):
    from collections import Counter, defaultdict

    from studyloom.plans import measured, planner

    beats, cards, concepts = scripts_at_random()
    b, k = spark.createDataFrame(beats, planner.PLAN_BEATS).coalesce(1), spark.createDataFrame(cards, planner.PLAN_CARDS).coalesce(1)
    c = spark.createDataFrame(concepts, "doc_id long, concept_id string, short_def string")
    found, skipped = lint_script.lint_script(b.filter("NOT cut"), Profile(), cards=k)
    assert skipped == measured.SKIPPED
    found = found.localCheckpoint()
    wanted = {(r.doc_id, r.rule, r.severity): r["count"] for r in found.groupBy("doc_id", "rule", "severity").count().collect()}
    assert {rule for _, rule, _ in wanted} == set(measured.RULES)
    got, rows = Counter(), []
    of_doc = defaultdict(lambda: ([], [], []))
    for n, table in enumerate((beats, cards, concepts)):
        for r in table:
            of_doc[r[0]][n].append(r)
    for doc, (said, pool, named) in of_doc.items():
        own = [planner.Card(*r[1:], (0, 0, 0)) for r in pool]
        script = measured.Script([x for x in map(measured.Beat._make, said) if not x.cut], own, Profile())
        for name, rule in measured.RULES.items():
            got.update((doc, name, severity) for severity in rule(script) if script.beats or name in ("STR-02", "RET-06"))
        if row := measured.measures_of(said, own, [{"concept_id": r[1], "short_def": r[2]} for r in named], Profile()):
            rows.append((doc, 10, 7, *row, 1.0))
    assert {x: (got[x], wanted.get(x)) for x in got.keys() | wanted.keys() if got[x] != wanted.get(x)} == {}
    blocks = clean.line_blocks(spark.createDataFrame([(d, "The wall is warm today and so on, as it is.\nOne two three") for d in of_doc], "doc_id long, text string"))
    words = F.lit(0.769)
    alone = evaluate.shown(spark.createDataFrame(rows, f"doc_id long, all_words long, kept_words long, {measured.MEASURES}, values_raw double"), 16, 5).withColumn("words_retained", words)
    together = evaluate.measure(triage.triage(blocks), b, k, c, found, rules_checked=16, rules_skipped=5).withColumn("words_retained", words)
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, together.collect())) and len(rows) > 50


def test_metrics_of_builds_write_and_shuffle_no_beats(spark, monkeypatch, tmp_path):
    from studyloom.catalog import scripts
    from studyloom.plans import pipeline

    lines = ["Spectral drift is defined as the slow change of a baseline signal.", "We show that spectral drift, 3.5 mV in all, causes the cell wall stress because the lamp was warm.", "Copyright notice, all rights reserved.", "1 2 3 4 5 6 7 8 9", "The solid electrolyte interphase (SEI) may grow, and the cell wall stress rises.", "short one", " \t"]
    texts = [(d, "\n".join(lines[(d + i * i) % 7] + (" Notably, spectral drift and the SEI met cell wall stress again." if i % 3 else "") for i in range(3 * d))) for d in range(9)]
    spark.createDataFrame([*texts, (9, None), (10, lines[3]), (11, " "), (None, lines[1])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    blocks = scripts.lines(spark, str(tmp_path))
    b = pipeline.build(blocks, cleaned=True)
    found, skipped = lint_script.lint_script(b.beats.filter("NOT cut"), Profile(), cards=b.cards)
    wanted = evaluate.measure(b.blocks, b.beats, b.cards, b.concepts, found, rules_checked=len(lint_script.SCRIPT_RULES) - len(skipped), rules_skipped=len(skipped))

    def refuse(df):
        raise AssertionError("a table was written")

    monkeypatch.setattr(pipeline, "written", refuse)
    got = scripts.QUERIES["build_metrics"](spark, str(tmp_path))
    shape = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in shape and shape.count("MapInArrow") == 1 and shape.count("Exchange hashpartitioning") <= 2  # the texts, then their sentences
    assert got.schema.simpleString() == wanted.schema.simpleString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect())) and got.count() > 6
