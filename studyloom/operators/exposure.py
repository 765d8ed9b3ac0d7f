"""Timelines, exposures, episodes, spacing and review state: time-ordered facts of a programme."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPISODE_SECONDS = 60.0
# The exposure form of each beat type, and the forms that spacing counts.
BEAT_FORMS = {"exposition": "statement", "callback": "callback", "prompt": "prompt", "recap": "recap", "anchor": "anchor", "preload": "preload", "prequestion": "prequestion"}
SPACED_FORMS = ["statement", "callback", "prompt", "recap", "anchor"]


def timeline(beats: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """``beats`` with ``at_seconds``: when each starts, from the lengths and pauses before it."""
    w = Window.partitionBy(*(keys or ["doc_id"])).orderBy(*(order or ["seq"]))
    before = F.sum(F.col("est_seconds") + F.col("pause_after")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return beats.withColumn("at_seconds", F.coalesce(before, F.lit(0.0)))


def exposure_log(beats: DataFrame) -> DataFrame:
    """(doc_id, concept_id, seq, at_seconds, beat_id, form, region, section_id): deliberate exposures.

    Of the expositions only the first that holds a concept counts; in the review every form is review.
    """
    forms = F.create_map(*[F.lit(x) for pair in BEAT_FORMS.items() for x in pair])
    rows = timeline(beats).withColumn("form", F.try_element_at(forms, F.col("type"))).filter("form IS NOT NULL").withColumn("concept_id", F.explode("concept_ids"))
    first = F.row_number().over(Window.partitionBy("doc_id", "concept_id", "type").orderBy("seq"))
    rows = rows.withColumn("nth", first).filter("type <> 'exposition' OR nth = 1")
    return rows.select("doc_id", "concept_id", "seq", "at_seconds", "beat_id", F.when(F.col("region") == "review", F.lit("review")).otherwise(F.col("form")).alias("form"), "region", "section_id")


def episodes(rows: DataFrame, keys: list[str], at: str = "at_seconds", section: str | None = "section_id", window: float = EPISODE_SECONDS, min_gap: float = 0.0) -> DataFrame:
    """The first exposure of every episode, with ``gap`` to the episode before.

    An exposure belongs to the last *kept* one's episode while it is within ``window`` of it, or
    within ``min_gap`` in the same section; so this is a fold over the ordered array of a key, not a
    session window (those extend with every event).
    """
    extra = [c for c in rows.columns if c not in keys]
    lead = F.struct(F.col(at).cast("double").alias("k_at"), *(F.col(c) for c in extra if c != at), F.col(at).alias("k_raw"))
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(lead)).alias("items"))
    same = (lambda a, b: a[section].isNotNull() & (a[section] == b[section])) if section else (lambda a, b: F.lit(False))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        gap = x["k_at"] - last["k_at"]
        return F.when(F.size(acc) == 0, F.array(x)).when((gap < window) | (same(last, x) & (gap < min_gap)), acc).otherwise(F.concat(acc, F.array(x)))

    kind = dict(grouped.dtypes)["items"]
    kept = F.aggregate("items", F.array().cast(kind), step)
    out = grouped.select(*keys, F.posexplode(kept).alias("episode", "e"))
    gap = F.col("e.k_at") - F.lag("e.k_at").over(Window.partitionBy(*keys).orderBy("episode"))
    return out.withColumn("gap", gap).select(*keys, "episode", F.col("e.k_raw").alias(at), *(F.col(f"e.{c}").alias(c) for c in extra if c != at), "gap")


def spaced(log: DataFrame, min_gap: float = 180.0) -> DataFrame:
    """Episodes of the body's exposures that the spacing rules apply to."""
    return episodes(log.filter((F.col("region") == "body") & F.col("form").isin(SPACED_FORMS)), ["doc_id", "concept_id"], min_gap=min_gap)


def expanding(episode_rows: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """(doc_id, concept_id, expanding): gaps never shrink by more than the tolerance up to a callback."""
    w = Window.partitionBy("doc_id", "concept_id").orderBy("episode")
    shrinks = (F.col("gap") < (1 - tolerance) * F.lag("gap").over(w)) & (F.col("form") == "callback")
    rows = episode_rows.withColumn("shrinks", F.coalesce(shrinks, F.lit(False)))
    return rows.groupBy("doc_id", "concept_id").agg(F.count("*").alias("n"), (~F.bool_or("shrinks")).alias("expanding")).filter("n > 2").drop("n")


# ---------------------------------------------------------------- spacing


def repetitions_for(difficulty: Column, importance: Column, least: int = 2, most: int = 3) -> Column:
    budget = F.least(F.lit(1.0), F.greatest(F.lit(0.0), difficulty * importance))
    return (F.lit(least) + F.bround(F.lit(most - least) * budget, 0)).cast("int")


def schedule_one(requests: list[dict], slots: list[dict], min_gap: float = 180.0, ratio: float = 2.5, bonus: float = 20.0) -> tuple[list[dict], dict[str, int], dict[str, float]]:
    """Place the callbacks of one programme: (placements, unplaced, minutes to the next review).

    Every concept wants growing intervals; a slot is taken at or after the least gap, the one nearest
    to the wished time, with a bonus for the concept's own section.  Slots are shared, so the greedy
    order (most repetitions, priority, earliest, id) is part of the result.
    """
    free = {s["slot_id"]: s.get("capacity", 2) for s in slots}
    times = sorted(slots, key=lambda s: (s["at_seconds"], s["slot_id"]))
    placed, unplaced, following = [], {}, {}
    for r in sorted(requests, key=lambda r: (-r["repetitions"], -r.get("priority", 0.0), r["first_at"], r["concept_id"])):
        at, interval, wanted = r["first_at"], 0.0, max(0, r["repetitions"] - 1)
        done = 0
        while done < wanted:
            need = max(min_gap, interval)
            wish = at + max(min_gap * ratio**done, need)
            cost = lambda s: abs(s["at_seconds"] - wish) - (bonus if r.get("section_id") is not None and s.get("section_id") == r.get("section_id") else 0.0)  # noqa: B023, E731
            open_slots = [s for s in times if s["at_seconds"] >= at + need and free[s["slot_id"]] > 0]
            if not open_slots:
                unplaced[r["concept_id"]] = wanted - done
                break
            best = min(open_slots, key=cost)
            free[best["slot_id"]] -= 1
            done += 1
            placed.append({"concept_id": r["concept_id"], "slot_id": best["slot_id"], "at_seconds": best["at_seconds"], "index": done})
            interval, at = best["at_seconds"] - at, best["at_seconds"]
        following[r["concept_id"]] = round(max(min_gap, interval) * ratio / 60.0, 2)
    return sorted(placed, key=lambda p: (p["at_seconds"], p["concept_id"], p["index"])), unplaced, following


def schedule(requests: DataFrame, slots: DataFrame, **policy: float) -> DataFrame:
    """(doc_id, concept_id, slot_id, at_seconds, index, next_interval_minutes); index 0 rows carry unplaced counts in slot_id null."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = [{k: (None if pd.isna(v) else v) for k, v in r.items()} for r in left.to_dict("records")]
        spots = [{k: (None if pd.isna(v) else v) for k, v in r.items()} for r in right.to_dict("records")]
        placed, unplaced, following = schedule_one(rows, spots, **policy)
        out = [(key[0], p["concept_id"], p["slot_id"], p["at_seconds"], p["index"], 0, following[p["concept_id"]]) for p in placed]
        out += [(key[0], c, None, None, 0, unplaced.get(c, 0), following[c]) for c in sorted(following)]
        return pd.DataFrame(out, columns=["doc_id", "concept_id", "slot_id", "at_seconds", "index", "unplaced", "next_interval_minutes"])

    schema = "doc_id bigint, concept_id string, slot_id string, at_seconds double, index int, unplaced int, next_interval_minutes double"
    return requests.groupBy("doc_id").cogroup(slots.groupBy("doc_id")).applyInPandas(run, schema)


def interleave_one(items: list[tuple[str, str]]) -> tuple[list[tuple[str, str]], int]:
    """Order (section, id) items so that neighbours differ in section; returns the order and the collisions left."""
    queues: dict[str, list[tuple[str, str]]] = {}
    for item in items:
        queues.setdefault(item[0] or "", []).append(item)
    out, before, collisions = [], None, 0
    while queues:
        ranked = sorted(queues, key=lambda k: (-len(queues[k]), k))
        pick = next((k for k in ranked if k != before), ranked[0])
        collisions += pick == before
        out.append(queues[pick].pop(0))
        if not queues[pick]:
            del queues[pick]
        before = pick
    return out, collisions


def interleave(cards: DataFrame) -> DataFrame:
    """(doc_id, card_id, section_id, position): a review order that mixes sections."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("card_id", kind="stable")
        order, _ = interleave_one(list(zip(group["section_id"].fillna(""), group["card_id"], strict=True)))
        return pd.DataFrame({"doc_id": group["doc_id"].iloc[0], "card_id": [c for _, c in order], "section_id": [s for s, _ in order], "position": range(len(order))})

    return cards.select("doc_id", "card_id", "section_id").groupBy("doc_id").applyInPandas(run, "doc_id bigint, card_id string, section_id string, position int")


# ---------------------------------------------------------------- budget


def budget_seconds(straight: Column, multiplier: float = 1.4, floor: float = 600.0) -> Column:
    return F.greatest(straight * multiplier, F.lit(floor))


# The order in which beat types are cut.
DROP_ORDER = ["analogy", "elaboration", "figure", "emphasis", "callback"]


def enforce_budget(beats: DataFrame, budgets: DataFrame) -> DataFrame:
    """``beats`` with ``cut``: removable beats in order of type, shortest section, place, until the plan fits.

    A beat is cut while what was cut before it does not yet cover the excess: a running sum.
    """
    length = F.col("est_seconds") + F.col("pause_after")
    rank = F.array_position(F.array(*map(F.lit, DROP_ORDER)), F.col("type"))
    sections = beats.groupBy("doc_id", "section_id").agg(F.sum(length).alias("section_seconds"), F.min("seq").alias("section_first"))
    totals = beats.groupBy("doc_id").agg(F.sum(length).alias("total_seconds")).join(budgets, "doc_id")
    rows = beats.withColumn("length", length).withColumn("type_rank", rank).join(sections, ["doc_id", "section_id"]).join(totals, "doc_id")
    removable = F.col("type_rank") > 0
    order = Window.partitionBy("doc_id", removable).orderBy("type_rank", "section_seconds", "section_first", "seq")
    before = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    cut = removable & (before < F.col("total_seconds") - F.col("budget_seconds"))
    return rows.withColumn("cut", cut).select(*beats.columns, "cut")


# ---------------------------------------------------------------- review log


def replay(log: DataFrame, card: str = "card_id", at: str = "at", tie: str | None = None, ratio: float = 2.5, most: float = 365.0) -> DataFrame:
    """Every answer with the interval it earned.

    Closed form of the replay: the first and every wrong answer earn one day, each right one after it
    multiplies by ``ratio``, up to ``most`` days; no state is kept anywhere.
    """
    w = Window.partitionBy(card).orderBy(at, *([tie] if tie else []))
    rows = log.withColumn("answer_no", F.row_number().over(w))
    anchor = F.max(F.when((F.col("answer_no") == 1) | ~F.col("correct"), F.col("answer_no"))).over(w)
    return rows.withColumn("interval_days", F.least(F.pow(F.lit(ratio), F.col("answer_no") - anchor), F.lit(most)))


def next_interval(previous: Column, correct: Column, ratio: float = 2.5, most: float = 365.0) -> Column:
    return F.when(~correct | (previous <= 0), F.lit(1.0)).otherwise(F.least(previous * ratio, F.lit(most)))


def card_state(log: DataFrame, card: str = "card_id", at: str = "at", tie: str | None = None) -> DataFrame:
    """(card, reviews, correct, last_at, interval_days, due_at)."""
    rows = replay(log, card, at, tie)
    state = rows.groupBy(card).agg(F.count("*").alias("reviews"), F.count_if("correct").alias("correct"), F.max(at).alias("last_at"), F.max_by("interval_days", "answer_no").alias("interval_days"))
    return state.withColumn("due_at", F.col("last_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round(F.col("interval_days") * 86400, 6).cast("decimal(18,6)")))


def select_session(cards: DataFrame, state: DataFrame, now: Column, count: int = 10, most_new: int = 5) -> DataFrame:
    """Up to ``count`` cards: those due, the longest overdue first, then the hardest new ones."""
    joined = cards.join(state, "card_id", "left")
    due = joined.filter(F.col("due_at") <= now).orderBy("due_at", "card_id").limit(count).withColumn("why", F.lit("due"))
    fresh = joined.filter(F.col("reviews").isNull()).orderBy(F.desc("difficulty"), "card_id").limit(most_new).withColumn("why", F.lit("new"))
    order = Window.orderBy(F.when(F.col("why") == "due", 0).otherwise(1), F.col("due_at").asc_nulls_last(), F.desc("difficulty"), "card_id")
    return due.unionByName(fresh).withColumn("position", F.row_number().over(order)).filter(F.col("position") <= count)


def review_status(log: DataFrame, now: Column, **names: str) -> DataFrame:
    """One row: answers, cards started, accuracy and how many are due."""
    state = card_state(log, **names)
    return state.agg(F.sum("reviews").alias("answers"), F.count("*").alias("cards_started"), F.bround(F.sum("correct") / F.sum("reviews"), 2).alias("accuracy"), F.count_if(F.col("due_at") <= now).alias("due"))
