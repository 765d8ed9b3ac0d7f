"""One document's metrics from its plan: the rules of ``operators/lint_script.py`` and the measures of ``operators/evaluate.py``.

The same steps on the beats and cards of a single document, so that the metrics of a build write no table of beats
and shuffle none.  The rules here are those that beats and cards suffice for; sums run in the order of the beats.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict, namedtuple
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

from studyloom.config import Profile
from studyloom.functions import spoken
from studyloom.operators import exposure, grounding
from studyloom.operators import lint_script as ops
from studyloom.plans import planner
from studyloom.plans.document import _alike
from studyloom.schema import GENERATED_TYPES, TEACHING_TYPES

Beat = namedtuple("Beat", [f.split(" ")[0] for f in planner.PLAN_BEATS.split(", ")])
#: What a document's plan says, as ``operators.evaluate.shown`` takes it.
MEASURES = (
    "minutes_raw double, budget_raw double, sections bigint, segments bigint, beats bigint, prompts bigint, with_spans bigint, owed bigint, gloss_raw double, spaced_raw double, recurring_concepts bigint, expanding_raw double, gap_raw double, "
    "lint_errors bigint, lint_warnings bigint, cards bigint"
)
ERROR, WARNING = "error", "warning"
_GENERATED, _TEACHING = frozenset(GENERATED_TYPES), frozenset(TEACHING_TYPES)
_WORD, _NAMED, _BLANKS = re.compile(r"[a-z0-9_'-]+"), re.compile(r"[a-z][a-z0-9_'-]*"), re.compile(r"([.!?])\s+", re.A)
_EXPLETIVE, _BARE, _FORMER, _TABLE, _FIGURE, _KINDS, _AXES = map(_alike, (spoken.EXPLETIVE, spoken.BARE_OPENING, spoken.FORMER, ops.ANNOUNCES_TABLE, ops.ANNOUNCES_FIGURE, ops.FIGURE_KINDS, ops.FIGURE_AXES))
_ENDS = re.compile("[.?!:;—](?:\r\n|[\n\r\x85\u2028\u2029])?\\Z")  # ends of lines as the column functions read $ and .
_LEAD = re.compile("^Here's the answer about [^\n\r\x85\u2028\u2029]*?\\.\\s*", re.I | re.A)
_NUMBER, _YEAR, _TAIL = re.compile("[0-9][0-9.,·]*"), re.compile(r"(?<![0-9])(1[6-9][0-9]{2}|20[0-9]{2})(?![0-9])"), re.compile(",([0-9]*)$")


def added(values: Iterable[float]) -> float:
    """Their plain sum, one after the other (``sum`` makes up for rounding)."""
    total = 0.0
    for v in values:
        total += v
    return total


class Script:
    """The beats of a document that are not cut, its cards, and what several rules need of them."""

    def __init__(self, beats: list[Beat], cards: list[planner.Card], profile: Profile):
        self.beats, self.cards, self.p = sorted(beats, key=lambda b: b.seq), cards, profile

    @cached_property
    def segments(self) -> dict[tuple, list[Beat]]:
        out: dict[tuple, list[Beat]] = defaultdict(list)
        for b in self.beats:
            if b.region == "body":
                out[b.section_id, b.segment_ix].append(b)
        return out

    @cached_property
    def log(self) -> list[tuple[str, float, Beat, str]]:
        """``operators.exposure.exposure_log``: (concept, when, beat, form)."""
        at, stated, out = 0.0, set(), []
        for b in self.beats:
            form = exposure.BEAT_FORMS.get(b.type)
            for c in (b.concept_ids or ()) if form else ():
                if b.type != "exposition" or c not in stated:
                    out.append((c, at, b, "review" if b.region == "review" else form))
                if b.type == "exposition":
                    stated.add(c)
            at += b.est_seconds + b.pause_after
        return out

    @cached_property
    def episodes(self) -> dict[str, list[tuple[float, str, str | None, float | None]]]:
        """``operators.exposure.spaced``: each concept's (when, form, section, gap)."""
        out: dict[str, list[tuple]] = defaultdict(list)
        for c, at, b, form in sorted(self.log, key=lambda x: (x[1], x[2].seq)):
            if b.region == "body" and form in exposure.SPACED_FORMS:
                kept = out[c]
                gap = at - kept[-1][0] if kept else None
                same = bool(kept) and b.section_id is not None and b.section_id == kept[-1][2]
                if gap is None or not (gap < exposure.EPISODE_SECONDS or (same and gap < self.p.min_gap_seconds)):
                    kept.append((at, form, b.section_id, gap))
        return out


# ---------------------------------------------------------------- rules: a severity for every violation


def prequestions_from_cards(s: Script) -> Iterator[str]:
    asked = [b for b in s.beats if b.type == "prequestion" and b.region == "opening" and b.card_id is not None]
    known, closed = {c.id for c in s.cards}, {b.card_id for b in s.beats if b.type == "prequestion_close"}
    yield from (ERROR for b in asked if b.card_id not in known or b.card_id not in closed)
    if s.cards and (len(asked) < min(2, len(s.cards)) or len(asked) > 4):
        yield ERROR


def section_ends(s: Script) -> Iterator[str]:
    types: dict[str | None, set[str]] = defaultdict(set)
    for (section, _), beats in s.segments.items():
        types[section] |= {b.type for b in beats}
    yield from (ERROR for here in types.values() for wanted in ("recap", "prompt") if wanted not in here)


def review_interleaved(s: Script) -> Iterator[str]:
    homes: dict[str, list[str | None]] = defaultdict(list)
    for c in s.cards:
        homes[c.id].append(c.section)
    said = [h for b in s.beats if b.region == "review" and b.type == "prompt" and b.card_id is not None for h in homes.get(b.card_id, [None])]
    yield from (ERROR for before, home in zip(said, said[1:], strict=False) if home is not None and before == home)


def segment_duration(s: Script) -> Iterator[str]:
    last: dict[str | None, int] = {}
    for section, k in s.segments:
        last[section] = max(k, last.get(section, k))
    for (section, k), beats in s.segments.items():
        seconds = added(b.est_seconds + b.pause_after for b in beats)
        if seconds > s.p.segment_max or (seconds < s.p.segment_min and k != last[section]):
            yield ERROR if seconds > s.p.segment_hard_max else WARNING


def new_terms(s: Script) -> Iterator[str]:
    home: dict[str, tuple] = {}
    fresh: dict[tuple, dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))
    for b in s.beats:
        if b.region == "body" and b.type in _TEACHING:
            place = (b.section_id, b.segment_ix)
            for c in b.concept_ids or ():
                if home.setdefault(c, place) == place:
                    fresh[place][b.seq].add(c)
    for said in fresh.values():
        if len(set().union(*said.values())) > s.p.max_new_terms:
            yield WARNING if max(map(len, said.values())) > s.p.max_new_terms else ERROR


def prompt_has_answer(s: Script) -> Iterator[str]:
    after: dict[tuple, str] = {}
    for b in reversed(s.beats):
        if b.type == "prompt" and after.get((b.region, b.section_id)) != "answer":
            yield ERROR
        after[b.region, b.section_id] = b.type


def prompt_has_pause(s: Script) -> Iterator[str]:
    yield from (ERROR for b in s.beats if b.type == "prompt" and b.pause_after < s.p.retrieval_min)


def repeats_not_verbatim(s: Script) -> Iterator[str]:
    said: dict[str, list[Beat]] = defaultdict(list)
    for c, _, b, form in s.log:
        if form in ("statement", "callback", "recap", "anchor"):
            said[c].append(b)
    held: dict[int, tuple[set[str], set[tuple[str, ...]]]] = {}

    def words(b: Beat) -> tuple[set[str], set[tuple[str, ...]]]:
        if b.seq not in held:
            w = _WORD.findall(b.text.lower())
            held[b.seq] = set(w), {tuple(w[i : i + ops.RUN]) for i in range(len(w) - ops.RUN + 1)}
        return held[b.seq]

    def verbatim(a: Beat, b: Beat) -> bool:
        (bag, runs), (bag0, runs0) = words(a), words(b)
        common = len(bag & bag0)
        return (common > 0 and common / (len(bag) + len(bag0) - common) > ops.VERBATIM) or not runs.isdisjoint(runs0)

    for beats in said.values():
        yield from (ERROR for _ in {b.beat_id for k, b in enumerate(beats) if any(a.seq < b.seq and verbatim(b, a) for a in beats[:k])})


def minimum_gap(s: Script) -> Iterator[str]:
    yield from (ERROR if form == "callback" else WARNING for kept in s.episodes.values() for _, form, _, gap in kept if gap is not None and gap < s.p.min_gap_seconds)


def grounded(s: Script) -> Iterator[str]:
    yield from (ERROR for b in s.beats if b.type not in _GENERATED and not b.generated and not b.spans)


def marked_as_ours(s: Script) -> Iterator[str]:
    yield from (ERROR for b in s.beats if b.type in ("anchor", "analogy") and not any(m in b.text.lower() for m in ops.OWNERSHIP))


def imagery_pause(s: Script) -> Iterator[str]:
    yield from (ERROR for b in s.beats if b.type in ("anchor", "analogy") and b.pause_after < s.p.imagery_min)


def canonical_number(token: str) -> str:
    """``operators.grounding.canonical_number``."""
    t = token.replace("·", ".").replace(" ", "")
    tail = _TAIL.search(t)
    if tail and "." not in t and len(tail[1]) != 3:
        t = _TAIL.sub(r".\1", t)
    t = t.replace(",", "")
    if "." in t:
        t = re.sub(r"\.$", "", re.sub("0+$", "", t))
    t = re.sub("^0+(?=[0-9])", "", t)
    return "0" if t == "" else f"0{t}" if t.startswith(".") else t


def numbers_in(text: str) -> set[str]:
    return {canonical_number(re.sub("[.,]+$", "", t)) for t in _NUMBER.findall(text)}


def facts_grounded(s: Script) -> Iterator[str]:
    for b in s.beats:
        if b.type in ("gloss", "anchor", "analogy", "elaboration") and (b.written_text or "").strip(" "):
            yield from (ERROR for _ in numbers_in(b.text) - numbers_in(b.written_text))
            yield from (ERROR for y in set(_YEAR.findall(b.text)) if y not in b.written_text)
            said, there = set(_NAMED.findall(b.text.lower())), set(_NAMED.findall(b.written_text.lower()))
            yield from (ERROR for pair in grounding.DIRECTIONS for used, opposite in (pair, pair[::-1]) if used in said and used not in there and opposite in there)


def whole_sentences(s: Script) -> Iterator[str]:
    yield from (ERROR for b in s.beats if (t := b.text.strip(" ")) and not _ENDS.search(t))


def resolved_openings(s: Script) -> Iterator[str]:
    before: dict[tuple, bool] = {}
    for b in s.beats:
        place = (b.region, b.section_id, b.segment_ix)
        if not b.generated and before.get(place, True):
            t = b.text.strip(" ")
            if not _EXPLETIVE.search(t) and (_BARE.search(t) or _FORMER.search(t)):
                yield WARNING
        before[place] = b.generated


def first_sentence(text: str) -> str:
    return next((x for x in _BLANKS.sub("\\1\x01", text.strip(" ")).split("\x01") if x.strip(" ")), "")


def table_announced(s: Script) -> Iterator[str]:
    yield from (ERROR for b in s.beats if b.type == "table" and b.text.strip(" ") and not _TABLE.search(first_sentence(b.text)))


def figure_template(s: Script) -> Iterator[str]:
    for b in s.beats:
        if b.type == "figure" and b.text.strip(" ") and not _FIGURE.search(b.text):
            if len(first_sentence(b.text)) > 125:
                yield WARNING
            if not _KINDS.search(b.text) or not _AXES.search(b.text):
                yield WARNING


def distinct_answers(s: Script) -> Iterator[str]:
    cores = Counter(_LEAD.sub("", c.answer).strip(" ") for c in s.cards)
    yield from (WARNING for core, n in cores.items() if n > 1 and core)


def true_transitions(s: Script, window: int = 3) -> Iterator[str]:
    for k, b in enumerate(s.beats):
        if b.type == "transition" and b.concept_ids and not any(c in b.concept_ids for x in s.beats[k + 1 : k + 1 + window] for c in x.concept_ids or ()):
            yield WARNING


RULES: dict[str, Callable[[Script], Iterator[str]]] = {
    "STR-02": prequestions_from_cards, "STR-06": section_ends, "STR-07": review_interleaved, "SEG-01": segment_duration, "SEG-03": new_terms, "RET-01": prompt_has_answer, "PAU-01": prompt_has_pause, "REP-01": repeats_not_verbatim, "SPC-01": minimum_gap,
    "GRD-01": grounded, "VOI-02": marked_as_ours, "PAU-02": imagery_pause, "GRD-03": facts_grounded, "TTS-04": whole_sentences, "SENT-02": resolved_openings, "TBL-02": table_announced, "FIG-01": figure_template, "RET-06": distinct_answers, "SEG-04": true_transitions,
}
#: Rules that want tables besides beats and cards.
SKIPPED = [name for name in (*ops.SCRIPT_RULES, *ops.ARTEFACT_RULES) if name not in RULES]


# ---------------------------------------------------------------- measures


def _mean(flags: list[bool]) -> float | None:
    return sum(flags) / len(flags) if flags else None


def _median(values: list[float]) -> float | None:
    v, k = sorted(values), (len(values) - 1) // 2
    return None if not v else v[k] if len(v) % 2 else 0.5 * v[k] + 0.5 * v[k + 1]


def measures_of(beats: Iterable[tuple], cards: list[planner.Card], concepts: list[dict], profile: Profile) -> tuple | None:
    """The ``MEASURES`` of a document's plan, none if it says nothing; ids of beats and concepts are unique in it."""
    s = Script([b for b in map(Beat._make, beats) if not b.cut], cards, profile)
    if not s.beats:
        return None
    said = [b for b in s.beats if b.type not in _GENERATED and b.text.strip(" ")]
    straight = added(b.est_seconds for b in s.beats if b.type in ("exposition", "table", "figure", "equation", "answer") and b.region is not None and b.region != "review")
    defined, met = {c["concept_id"] for c in concepts if c["short_def"] is not None}, {c for c, *_ in s.log}
    grows = [not any(form == "callback" and gap < (1 - 0.10) * kept[k][3] for k, (_, form, _, gap) in enumerate(kept[2:], 1)) for kept in s.episodes.values() if len(kept) > 2]
    gap = _median([e[3] for kept in s.episodes.values() for e in kept if e[3] is not None])
    found = Counter(severity for rule in RULES.values() for severity in rule(s))
    return (
        added(b.est_seconds + b.pause_after for b in s.beats) / 60, max(straight * profile.duration_multiplier, profile.duration_floor_seconds) / 60, len({b.section_id for b in s.beats} - {None}), len({(b.section_id, b.segment_ix) for b in s.beats if b.section_id is not None and b.segment_ix is not None}), len(s.beats),
        sum(b.type == "prompt" for b in s.beats), sum(bool(b.spans) for b in said), len(said), _mean([c in defined for c in met]), _mean([len(s.episodes.get(c, ())) > 1 for c in met]), sum(len(s.episodes.get(c, ())) > 2 for c in met), _mean(grows), None if gap is None else gap / 60,
        found[ERROR], found[WARNING], len(cards),
    )
