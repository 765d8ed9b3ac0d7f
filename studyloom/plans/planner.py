"""The planner: one document's sentences, concepts and supports into beats and cards.

The facts a plan needs (sentences with their concepts, ranked supports, definitions) are computed
set-wise beforehand; laying them out is inherently sequential, because each choice spends time,
supports and slots that the next one sees.  So it is one fold per document (``plans/pipeline.py``).
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from studyloom.config import Profile
from studyloom.functions.spoken import leans, speak
from studyloom.operators.exposure import DROP_ORDER, interleave_one, schedule_one
from studyloom.schema import TEACHING_TYPES

BEAT_SECONDS = 22.0
PLAN_BEATS = "doc_id bigint, seq int, region string, section_id string, segment_ix int, beat_id string, type string, text string, written_text string, concept_ids array<string>, est_seconds double, pause_after double, generated boolean, card_id string, spans array<struct<block:int,char_start:int,char_end:int>>, cut boolean"
PLAN_CARDS = "doc_id bigint, card_id string, concept_id string, subject string, prompt string, answer string, prompt_type string, difficulty double, section_id string"
COUNTS = "no one two three four five six seven eight nine ten".split()
ORDINALS = "First Second Third Fourth".split()


def _hash(*parts: str) -> str:
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:12]


def closed(text: str) -> str:
    """Text that starts with a word and ends as a sentence."""
    out = re.sub(r"^[\s.,;:—-]+", "", text.strip())
    return out if not out or out[-1] in ".?!:;—" else f"{out}."


def listing(names: list[str]) -> str:
    return names[0] if len(names) == 1 else f"{', '.join(names[:-1])} and {names[-1]}" if names else ""


def plain_title(title: str) -> str:
    return re.sub(r"^\s*(?:\d+(?:\.\d+)*|[IVXLC]+)[.)]?\s+", "", title).strip().rstrip(".").lower() or "the next part"


@dataclass
class Beat:
    type: str
    text: str
    seconds: float
    pause: float = 0.0
    concepts: list[str] = field(default_factory=list)
    generated: bool = True
    written: str | None = None
    card: str | None = None
    spans: list[tuple[int, int, int]] = field(default_factory=list)
    id: str = ""
    cut: bool = False

    @property
    def total(self) -> float:
        return self.seconds + self.pause


def length(beats: list[Beat]) -> float:
    return sum(b.total for b in beats)


@dataclass
class Card:
    id: str
    concept: str | None
    subject: str
    prompt: str
    answer: str
    kind: str
    difficulty: float
    section: str
    span: tuple[int, int, int]


class Plan:
    """The layout of one document."""

    def __init__(self, profile: Profile, title: str, sentences: list[dict], concepts: list[dict], supports: list[dict], lexicon: dict[str, str] | None = None):
        self.p, self.title, self.lexicon = profile, title, lexicon or {}
        self.concepts = {c["concept_id"]: c for c in sorted(concepts, key=lambda c: (-c["budget"], c["canonical"]))}
        self.supports: dict[str, list[dict]] = {}
        for s in sorted(supports, key=lambda s: (s["concept_id"], s["rank"])):
            self.supports.setdefault(s["concept_id"], []).append(s)
        self.spent: set[tuple[int, int]] = set()
        self.met: set[str] = set()
        self.announced: set[str] = set()
        self.salts: dict[tuple[str, str], int] = {}
        self.spoken: dict[str, str] = {}
        self.cards: list[Card] = []
        self.sections: list[tuple[str, str, list[list[Beat]]]] = []
        self._lay_out(sentences)

    # -- beats

    def say(self, text: str) -> str:
        if text not in self.spoken:
            self.spoken[text] = closed(speak(text, self.p.numeric_fidelity, self.p.significant_figures, self.p.citations, self.lexicon))
        return self.spoken[text]

    def beat(self, kind: str, text: str, spoken: bool = False, **more: object) -> Beat:
        said = closed(text) if spoken else self.say(text)
        salt = self.salts[(kind, said)] = self.salts.get((kind, said), -1) + 1
        return Beat(kind, said, self.p.seconds_for(said), id=f"t_{_hash(kind, said, str(salt))}", **more)  # type: ignore[arg-type]

    def name(self, concept: str) -> str:
        return self.concepts[concept]["canonical"]

    def stated(self, concept: str) -> tuple[int, int, int] | None:
        """Where the document states what a concept means."""
        at = self.concepts[concept].get("def_at")
        return (at["ord"], at["char_start"], at["char_end"]) if at else None

    def exposition(self, rows: list[dict]) -> list[Beat]:
        """The source's sentences, gathered until a beat is long enough, never across blocks."""
        out: list[Beat] = []
        held: list[dict] = []
        seconds: list[float] = []

        def close() -> None:
            if held:
                raw = " ".join(r["text"].strip() for r in held)
                said = self.say(raw)
                if said:
                    found = list(dict.fromkeys(c for r in held for c in r["concept_ids"] if c in self.concepts))
                    out.append(self.beat("exposition", said, True, concepts=found, generated=False, written=raw, spans=[(held[0]["ord"], held[0]["char_start"], held[-1]["char_end"])]))
                held.clear()
                seconds.clear()

        for r in rows:
            if held and held[0]["ord"] != r["ord"]:
                close()
            held.append(r)
            seconds.append(self.p.seconds_for(r["text"]))
            if sum(seconds) >= BEAT_SECONDS:
                close()
        close()
        return out

    def prompt_pair(self, card: Card) -> list[Beat]:
        pause = min(max(self.p.retrieval_min, 0.5 * self.p.seconds_for(card.answer)), self.p.retrieval_max)
        about = [card.concept] if card.concept else []
        return [self.beat("prompt", f"{card.prompt} Take a few seconds.", pause=pause, concepts=about, card=card.id), self.beat("answer", card.answer, True, concepts=about, generated=False, written=card.answer, card=card.id, spans=[card.span])]

    # -- cards

    def best(self, concept: str) -> dict | None:
        return next((s for s in self.supports.get(concept, []) if (s["ord"], s["sent_ix"]) not in self.spent), None)

    def card_for(self, concept: str, section: str) -> Card | None:
        support = self.best(concept)
        if support is None:
            return None
        self.spent.add((support["ord"], support["sent_ix"]))
        name = self.name(concept)
        if support["definitional"]:
            question, kind = f"What does {name} mean?", "definition"
        elif support["causal"]:
            question, kind = f"What did the paper say explains {name}?", "mechanism"
        elif re.search(r"\d", support["text"]):
            question, kind = f"What did they report for {name}?", "value"
        else:
            question, kind = f"What did the paper say about {name}?", "recall"
        return self._card(concept, name, question, support, kind, section, self.concepts[concept]["difficulty"])

    def _card(self, concept: str | None, subject: str, question: str, support: dict, kind: str, section: str, difficulty: float) -> Card:
        answer = f"{self.say(f'Here is the answer about {subject}.')} {self.say(support['text'])}"
        card = Card(f"k_{_hash('prompt', question, str(support['ord']), str(support['sent_ix']))}", concept, subject, self.say(question), answer, kind, difficulty, section, (support["ord"], support.get("char_start", 0), support.get("char_end", 0)))
        self.cards.append(card)
        return card

    def section_card(self, rows: list[dict], fresh: list[str], present: list[str], section: str, title: str) -> Card | None:
        for concept in [*fresh, *present]:
            card = self.card_for(concept, section)
            if card:
                return card
        usable = [r for r in rows if 6 <= len(r["text"].split()) <= 35 and (r["ord"], r["sent_ix"]) not in self.spent]
        if not usable:
            return None
        best = max(usable, key=lambda r: (r.get("score", 0.0), -r["ord"], -r["sent_ix"]))
        self.spent.add((best["ord"], best["sent_ix"]))
        subject = plain_title(title)
        return self._card(None, subject, f"What did the part on {subject} say?", best, "recall", section, 0.0)

    # -- layout

    def _lay_out(self, sentences: list[dict]) -> None:
        groups: dict[str, list[dict]] = {}
        for r in sorted(sentences, key=lambda r: (r["ord"], r["sent_ix"])):
            groups.setdefault(r["section_id"], []).append(r)
        titles = {s: next((r["section_title"] for r in rows if r["section_title"]), s) for s, rows in groups.items()}
        for k, (section, rows) in enumerate(groups.items()):
            present = sorted({c for r in rows for c in r["concept_ids"] if c in self.concepts}, key=lambda c: (-self.concepts[c]["budget"], self.name(c)))
            fresh = [c for c in present if c not in self.met]
            card = self.section_card(rows, fresh, present, section, titles[section])
            run = [self.beat("position", f"Part {k + 1} of {len(groups)}. {titles[section]}.", pause=self.p.section_pause)]
            run += [self.beat("gloss", f"{self.name(c)}, in short. {self.concepts[c]['short_def']}", concepts=[c], generated=False, written=self.concepts[c]["short_def"], spans=[self.stated(c) or (rows[0]["ord"], rows[0]["char_start"], rows[0]["char_end"])]) for c in fresh if self.concepts[c].get("short_def")]
            run += self.exposition(rows)
            segments = self.segments(run, titles[section])
            self.emphasize(segments)
            self.prompts(segments, section)
            last = segments[-1]
            names = [self.name(c) for c in fresh[:3]]
            last.append(self.beat("recap", f"So, {plain_title(titles[section])} in one line: {listing(names)}." if names else f"That was {plain_title(titles[section])}.", concepts=fresh[:3]))
            if card:
                last += self.prompt_pair(card)
            last[-1].pause = max(last[-1].pause, self.p.section_pause)
            self.sections.append((section, titles[section], segments))
        self.asked = sorted(self.cards, key=lambda c: (-self.concepts.get(c.concept or "", {}).get("budget", 0.0), c.id))[: max(2, min(self.p.max_prequestions, 4))]
        self.close_questions()
        self.callbacks()
        self.resize()
        self.review = self.make_review()
        self.opening = self.make_opening(sentences)
        self.fit()

    def segments(self, run: list[Beat], title: str) -> list[list[Beat]]:
        """Cut by the clock and by the number of new terms, never before an opening that leans on what was said."""
        out: list[list[Beat]] = [[]]
        seconds, new = 0.0, set()
        for b in run:
            fresh = {c for c in b.concepts if b.type in TEACHING_TYPES and c not in self.met}
            long = seconds + b.total > self.p.segment_hard_max or (seconds >= self.p.segment_min and seconds + b.total > self.p.segment_max)
            many = len(new | fresh) > self.p.max_new_terms
            if out[-1] and (long or many) and not (leans(b.text) and seconds + b.total <= self.p.segment_hard_max):
                self.met |= new
                out.append([])
                seconds, new = 0.0, set()
                fresh = {c for c in fresh if c not in self.met}
            out[-1].append(b)
            seconds += b.total
            new |= fresh
        self.met |= new
        seen: set[str] = set()
        for here, after in zip(out, out[1:], strict=False):
            seen |= {c for b in here for c in b.concepts}
            here.append(self.bridge(seen, after, title))
        return out

    def bridge(self, seen: set[str], after: list[Beat], title: str) -> Beat:
        """A transition that says what the beats after it are about."""
        ahead = [c for b in after[:3] for c in b.concepts if c not in self.announced]
        pick = next((c for c in ahead if c not in seen), ahead[0] if ahead else None)
        if pick:
            self.announced.add(pick)
        text = f"Still on {plain_title(title)}." if pick is None else f"Next, {self.name(pick)}." if pick not in seen else f"More on {self.name(pick)}."
        return self.beat("transition", text, pause=self.p.segment_pause, concepts=[pick] if pick else [])

    def resize(self) -> None:
        """Segments of the wanted length once everything is in them: short ones join the next, over-long ones are cut."""
        known: set[str] = set()

        def fresh(beats: list[Beat]) -> set[str]:
            return {c for b in beats if b.type in TEACHING_TYPES for c in b.concepts} - known

        for place, (section, title, segments) in enumerate(self.sections):
            joined: list[list[Beat]] = []
            for seg in segments:
                if joined and length(joined[-1]) < self.p.segment_min and length(joined[-1]) + length(seg) <= self.p.segment_hard_max and len(fresh(joined[-1] + seg)) <= max(self.p.max_new_terms, len(fresh(seg))):
                    joined[-1] = [b for b in joined[-1] if b.type != "transition"] + seg
                else:
                    known |= fresh(joined[-1]) if joined else set()
                    joined.append(seg)
            known |= fresh(joined[-1])
            self.sections[place] = (section, title, [part for seg in joined for part in self.cut(seg, title)])

    def cut(self, rest: list[Beat], title: str) -> list[list[Beat]]:
        """Parts under the hard maximum where a boundary allows it: an answer stays with its prompt, an announcement with what it
        announces, and no part starts with words that lean on what was said."""
        out = []
        while length(rest) > self.p.segment_hard_max:
            bound = lambda k: rest[k].type in ("answer", "prequestion_close", "transition") or rest[k - 1].type in ("position", "emphasis") or leans(rest[k].text)  # noqa: E731, B023
            places = [k for k in range(1, len(rest)) if not bound(k)]
            if not places:
                break
            at = max((k for k in places if length(rest[:k]) <= self.p.segment_max), default=places[0])
            before, rest = rest[:at], rest[at:]
            out.append([*before, self.bridge({c for b in before for c in b.concepts}, rest, title)])
        return [*out, rest]

    def emphasize(self, segments: list[list[Beat]]) -> None:
        places = [(self.concepts[c]["importance"], -s, -k, c) for s, seg in enumerate(segments) for k, b in enumerate(seg) if b.type == "exposition" for c in b.concepts]
        if places and self.p.emphasis_per_section:
            _, s, k, concept = max(places)
            segments[-s].insert(-k, self.beat("emphasis", f"This next part is the core of it, and it's about {self.name(concept)}.", concepts=[concept]))

    def prompts(self, segments: list[list[Beat]], section: str) -> None:
        for seg in segments[:-1]:
            taught = list(dict.fromkeys(c for b in seg if b.type in TEACHING_TYPES for c in b.concepts))
            done = 0
            for concept in taught[:4]:
                if done >= self.p.prompts_per_segment:
                    break
                card = self.card_for(concept, section)
                if card:
                    end = len(seg) - (seg[-1].type == "transition")
                    seg[end:end] = self.prompt_pair(card)
                    done += 1

    def close_questions(self) -> None:
        """Say where a question of the opening is answered, once."""
        for card in self.asked:
            for _, _, segments in self.sections:
                spot = next(((seg, k) for seg in segments for k, b in enumerate(seg) if b.card == card.id and b.type == "answer"), None)
                if spot:
                    about = [card.concept] if card.concept else []
                    spot[0].insert(spot[1] + 1, self.beat("prequestion_close", f"That was one of the questions I asked at the start, the one about {card.subject}.", concepts=about, card=card.id))
                    break

    def callbacks(self) -> None:
        at, first, slots, ends = 0.0, {}, [], {}
        for section, _, segments in self.sections:
            for k, seg in enumerate(segments):
                for b in seg:
                    for c in b.concepts:
                        if b.type in ("exposition", "prompt", "recap"):
                            first.setdefault(c, (at, section))
                            first[c] = (first[c][0] if b.type == "exposition" else max(first[c][0], at), first[c][1])
                    at += b.total
                slot = f"{section}/{k}"
                slots.append({"slot_id": slot, "at_seconds": at, "section_id": section})
                ends[slot] = seg
        requests = []
        for c, (when, section) in first.items():
            worth = min(1.0, max(0.0, self.concepts[c]["difficulty"] * self.concepts[c]["importance"]))
            requests.append({"concept_id": c, "first_at": when, "repetitions": self.p.repetitions_min + round((self.p.repetitions_max - self.p.repetitions_min) * worth), "section_id": section, "priority": worth})
        heard = {(s[0], s[1], s[2]) for _, _, segments in self.sections for seg in segments for b in seg if b.type == "exposition" for s in b.spans}
        placed, self.unplaced, self.next_minutes = schedule_one(requests, slots, self.p.min_gap_seconds, self.p.interval_ratio)
        for spot in placed:
            concept = spot["concept_id"]
            support = next((s for s in self.supports.get(concept, []) if (s["ord"], s["sent_ix"]) not in self.spent and not any(o == s["ord"] and a <= s.get("char_start", 0) and s.get("char_end", 0) <= e for o, a, e in heard)), None)
            if support is None:
                self.unplaced[concept] = self.unplaced.get(concept, 0) + 1
                continue
            self.spent.add((support["ord"], support["sent_ix"]))
            text = f"{self.say(f'Back to {self.name(concept)} for a moment.')} {self.say(support['text'])}"
            ends[spot["slot_id"]].append(self.beat("callback", text, True, concepts=[concept], generated=False, written=support["text"], spans=[(support["ord"], support.get("char_start", 0), support.get("char_end", 0))]))

    def make_review(self) -> list[Beat]:
        if not self.cards:
            return []
        order, _ = interleave_one([(c.section, c.id) for c in sorted(self.cards, key=lambda c: c.id)])
        by = {c.id: c for c in self.cards}
        count = COUNTS[len(order)] if len(order) < len(COUNTS) else str(len(order))
        lead = self.beat("review", f"That's the paper. Now {count} questions across all of it, in mixed order.", pause=self.p.section_pause)
        return [lead, *(b for _, c in order for b in self.prompt_pair(by[c]))]

    def make_opening(self, sentences: list[dict]) -> list[Beat]:
        body = [b for _, _, segments in self.sections for seg in segments for b in seg]
        minutes = max(1, round(sum(b.total for b in [*body, *self.review]) / 60))
        promises = [c["canonical"] for c in list(self.concepts.values())[:3]]
        text = f"This is {self.title or 'a paper'}. It takes about {minutes} minutes." + (f" It turns on {listing(promises)}." if promises else "")
        out = [self.beat("orientation", text, pause=self.p.segment_pause)]
        if len(self.asked) >= 2:
            out.append(self.beat("prequestion", f"Before we start, here are {COUNTS[len(self.asked)]} questions to hold on to. You're not meant to know the answers yet."))
            out += [self.beat("prequestion", f"{ORDINALS[k]}. {c.prompt}", pause=self.p.imagery_min, concepts=[c.concept] if c.concept else [], card=c.id) for k, c in enumerate(self.asked)]
        terms = [c for c in self.concepts.values() if c.get("short_def")][: self.p.max_preload]
        if terms:
            out.append(self.beat("preload", f"First, {COUNTS[len(terms)]} word{'s' if len(terms) > 1 else ''} you'll need."))
            out += [self.beat("preload", f"{c['canonical']}. {c['short_def']}", concepts=[c["concept_id"]], spans=[at] if (at := self.stated(c["concept_id"])) else []) for c in sorted(terms, key=lambda c: (c.get("first_ord", 0), c["canonical"]))]
        return out

    def fit(self) -> None:
        """Cut beats in the order of their types, shortest section first, while the plan is over its budget."""
        body = [(s, b) for s, _, segments in self.sections for seg in segments for b in seg]
        straight = sum(b.seconds for _, b in body if b.type in ("exposition", "table", "figure", "equation", "answer"))
        self.budget = max(straight * self.p.duration_multiplier, self.p.duration_floor_seconds)
        total = sum(b.total for b in [*self.opening, *self.review]) + sum(b.total for _, b in body)
        lengths = {s: sum(b.total for t, b in body if t == s) for s, _, _ in self.sections}
        places = {s: k for k, (s, _, _) in enumerate(self.sections)}
        for kind in DROP_ORDER:
            for s, b in sorted(body, key=lambda sb: (lengths[sb[0]], places[sb[0]])):
                if b.type == kind and total > self.budget:
                    b.cut, total = True, total - b.total

    def rows(self, doc: int) -> list[tuple]:
        out = []

        def add(region: str, section: str | None, segment: int | None, beats: list[Beat]) -> None:
            for b in beats:
                out.append((doc, len(out), region, section, segment, b.id, b.type, b.text, b.written, b.concepts, b.seconds, b.pause, b.generated, b.card, [{"block": o, "char_start": a, "char_end": e} for o, a, e in b.spans], b.cut))

        add("opening", None, None, self.opening)
        for section, _, segments in self.sections:
            for k, seg in enumerate(segments):
                add("body", section, k, seg)
        add("review", None, None, self.review)
        return out

    def card_rows(self, doc: int) -> list[tuple]:
        return [(doc, k.id, k.concept, k.subject, k.prompt, k.answer, k.kind, k.difficulty, k.section) for k in self.cards]


def as_array(ddl: str) -> str:
    """The type of an array of such rows."""
    return f"array<struct<{', '.join(f'{name}:{kind}' for name, kind in (f.split(' ', 1) for f in re.split(r', (?=[a-z_]+ [a-z])', ddl)))}>>"
