"""One document's way from its sentences to its plan: concepts, mentions, definitions, scores, supports.

The steps of ``operators/concepts.py`` on the lists of a single document, so that a build shuffles every text
once and writes no table of sentences or mentions.  What patterns say about a sentence comes as its columns
(``described``), worked out by the same column functions; names of concepts hold ASCII only.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.config import Listener
from studyloom.functions.spoken import GREEK
from studyloom.functions.text import NBSP
from studyloom.operators import concepts as ops
from studyloom.schema import NON_CONTENT_ROLES

_STOP = frozenset(ops.STOPWORDS)
_CLAUSE, _NOISE = re.compile(ops.CLAUSE_LIKE, re.A), re.compile(ops.PUBLICATION_NOISE, re.A)
_EDGES = re.compile(r"^[ ,;:.()\[\]]+|[ ,;:.()\[\]]+$")
_BLANKS = re.compile(r"\s+", re.A)
_ABSTRACT, _CONCRETE = re.compile("(" + "|".join(ops.ABSTRACT_SUFFIXES) + ")$"), re.compile("(" + "|".join(ops.CONCRETE_SUFFIXES) + ")$")
_WORDS, _PLAIN = re.compile(r"[A-Za-z][A-Za-z0-9_'-]*"), re.compile(r"[a-z][a-z'-]+")
_CONNECTIVES, _CLAUSES = re.compile(r"\b(and|or|between|with|relative to|per|versus|while)\b", re.I | re.A), re.compile(r"\b(which|that|where|when|whose)\b", re.I | re.A)
_BAG, _DIGITS, _SOLID = re.compile(r"[a-z0-9_'-]+"), re.compile("[0-9]"), re.compile(r"\S+", re.A)


def _alike(pattern: str) -> re.Pattern:
    """The pattern as the column functions read it: ASCII classes and cases, word boundaries of any letters."""
    return re.compile(pattern.replace(r"\b", r"(?u:\b)"), re.A)


_AUTHOR, _DEFINES, _CAUSES, _HEDGE = map(_alike, (ops.AUTHOR_SIGNALS, ops.DEFINES, ops.CAUSES, ops.HEDGE))
SIGNALS = (*ops.DIFFICULTY, *ops.IMPORTANCE)


def described(sentences: DataFrame) -> DataFrame:
    """``sentences`` (doc_id, ord, sent_ix, char_start, char_end, text, kind, role, section) with what the patterns say of each."""
    groups = lambda pattern, *of: F.arrays_zip(*(F.regexp_extract_all("text", F.lit(pattern), k).alias(n) for k, n in enumerate(of, 1)))
    weight, place = F.lit(0.4), F.lit(0.0)
    for name, value in ops.ROLE_WEIGHTS.items():
        weight = F.when(F.col("role") == name, F.lit(value)).otherwise(weight)
    for name, value in ops.POSITIONS.items():
        place = F.when(F.coalesce("role", F.lit("body")) == name, F.lit(value)).otherwise(place)
    yes = lambda test: F.coalesce(test, F.lit(False))
    content = yes(~F.col("kind").isin(ops.SKIP_KINDS) & ~F.col("role").isin(ops.SKIP_ROLES))
    return sentences.withColumns({
        "weight": weight, "content": content, "prose": yes(~F.col("kind").isin("page_artifact", "reference", "caption") & ~F.col("role").isin(NON_CONTENT_ROLES)), "supports": yes(~F.col("kind").isin("heading", "reference", "page_artifact", "caption")), "place": place, "caption": yes(F.col("kind") == "caption"),
        "acronyms": F.when(content & F.contains("text", F.lit("(")), groups(ops.ACRONYM, "a", "b")), "symbols": F.when(content & F.col("text").rlike(r"\sis\s"), groups(ops.SYMBOL, "a", "b")),
        "defined": F.when(content & F.col("text").rlike(ops.DEFINITIONAL_WORDS), F.concat(*(F.regexp_extract_all("text", F.lit(p), 1) for p in ops.DEFINITIONAL))),
    }).drop("kind", "role")


def judge(r: dict) -> None:
    """What a sentence that mentions a concept is worth: ``crowding``, ``informativeness``, ``supports`` and their patterns."""
    text = r["text"]
    n, w, digits = len(_SOLID.findall(text.replace(NBSP, " "))), len(_WORDS.findall(text)), len(_DIGITS.findall(text))
    r["crowd"] = w / 25.0 + digits / 20.0 + text.count(",") / 6.0 if w else None
    r["author"], r["definitional"], r["causal"] = (p.search(text) is not None for p in (_AUTHOR, _DEFINES, _CAUSES))
    r["supports"] = r["supports"] and 6 <= n <= 35
    if r["supports"]:
        worth = 0.5 * min(n / 25.0, 1.0) + 0.5 * min(digits / n * 4, 1.0) - (0.2 if _HEDGE.search(text) else 0.0)
        r["score"] = r["weight"] + worth + (0.8 if r["definitional"] else 0.0)
        r["order_score"] = Decimal(repr(r["score"])).quantize(Decimal("1e-9"), ROUND_HALF_UP)


# ---------------------------------------------------------------- concepts


def acronym_of(expansion: str, acronym: str) -> str | None:
    """The words that an acronym stands for, where their initials go with it (``operators.concepts.acronyms``)."""
    w = _BLANKS.split(expansion)
    at = next((k for k, x in enumerate(w) if x.lower() not in _STOP), None)
    if at is None:
        return None
    w = w[at:]
    initials = [x[:1].lower() for x in w if x.lower() not in _STOP]
    letters = re.findall("[a-z]", re.sub("s$", "", acronym).lower())
    hits = sum(a == b for a, b in zip(letters, initials, strict=False))
    return " ".join(w) if len(letters) >= 2 and hits >= max(2, len(letters) // 2) else None


def like_phrase(text: str) -> bool:
    """``operators.concepts.phrase_like``."""
    w = text.split(" ")
    return ops.MIN_WORDS <= len(w) <= ops.MAX_WORDS and w[0] not in ops._BOUNDS and w[-1] not in ops._BOUNDS and text not in ops._NEVER and ops._JOINTS.isdisjoint(w) and all(len(x) > 1 for x in w)


def candidates_of(rows: list[dict]) -> list[dict]:
    """``operators.concepts.candidates`` of one document."""
    found: list[tuple] = []  # ord, canonical, kind, alias, short_def, source
    for r in rows:
        for p in r["acronyms"] or ():
            if name := acronym_of(p["a"], p["b"]):
                found.append((r["ord"], name, "term", p["b"], None, "acronym"))
        for name in r["defined"] or ():
            if like_phrase(_BLANKS.sub(" ", name).lower()) or len(name.split()) == 1:
                found.append((r["ord"], name, "term", None, None, "definition"))
        for p in r["symbols"] or ():
            found.append((r["ord"], GREEK.get(p["a"], p["a"]), "symbol", p["a"], p["b"], "symbol"))
    found += [(at, name, "term", None, None, "repetition") for _, _, at, name in ops.repeated_terms([(r["ord"], r["sent_ix"], r["text"]) for r in rows if r["content"]])]
    groups: dict[str, list[tuple]] = defaultdict(list)
    for at, name, *rest in found:
        name = _EDGES.sub("", _BLANKS.sub(" ", name)).strip(" ")
        if len(name) >= 3 and not _CLAUSE.search(name) and not _NOISE.search(name):
            groups[name.lower()].append((at, name, *rest))
    out = []
    for key, members in groups.items():
        at, name, kind, *_ = min(members, key=lambda m: m[:2])
        short = min((m for m in members if m[4] is not None), key=lambda m: m[:2], default=None)
        out.append({"concept_id": "c_" + hashlib.sha256(key.encode()).hexdigest()[:10], "canonical": name, "kind": kind, "aliases": sorted({m[3] for m in members if m[3] is not None}), "short_def": short and short[4], "first_ord": at})
    return out


def hits_of(worded: list[list[str]], keyed: list[tuple[str, str]]) -> list[Counter]:
    """``operators.concepts.phrase_hits``: how often each sentence holds each item's (phrase, item) phrases."""
    heads: dict[str, list[tuple[tuple[str, ...], str]]] = defaultdict(list)
    for phrase, item in set(keyed):
        if phrase:
            heads[(w := tuple(phrase.split(" ")))[0]].append((w, item))
    out = []
    for t in worded:
        out.append(here := Counter())
        for i, word in enumerate(t):
            for w, item in heads.get(word, ()):
                if len(w) == 1 or tuple(t[i : i + len(w)]) == w:
                    here[item] += 1
    return out


def definitions_of(rows: list[dict], worded: list[list[str]], terms: list[str], share: float = 0.8) -> dict[str, tuple[str, dict]]:
    """``operators.concepts.find_definitions``: each term's first acceptable definition and its sentence."""
    blocks = sorted({r["ord"] for r in rows if r["prose"]})
    early = set(blocks[: max(1, math.floor(len(blocks) * share))])
    places = [k for k, r in enumerate(rows) if r["prose"] and r["ord"] in early]
    out: dict[str, tuple[str, dict]] = {}
    for k, here in zip(places, hits_of([worded[k] for k in places], [(" ".join(ops.tokens_of(t)), t) for t in terms]), strict=True):
        for term in here:
            if term not in out and (said := ops.definition_of(term, rows[k]["text"])) is not None:
                out[term] = (said, {x: rows[k][x] for x in ("ord", "char_start", "char_end")})
    return out


# ---------------------------------------------------------------- scores


def _concreteness(w: str) -> float:
    return 3.0 if len(w) <= 3 else 1.8 if _ABSTRACT.search(w) else 4.0 if _CONCRETE.search(w) else 2.5 if len(w) >= 11 else 3.6 if len(w) <= 5 else 3.0


def own_signals(canonical: str, short_def: str | None) -> dict[str, float]:
    """The signals that a concept's words give (``abstractness``, ``interactivity``, ``unfamiliarity`` of the operators)."""
    scores, w, text = [_concreteness(x) for x in _PLAIN.findall(canonical.lower())], _WORDS.findall(canonical), short_def if short_def is not None else canonical
    mean = sum(scores, 0.0) / len(scores) if scores else 3.0
    return {
        "abstractness": (5 - min(5.0, max(1.0, mean))) / 4,
        "interactivity": float(sum(len(x) > 3 for x in _WORDS.findall(text)) + 2 * len(_CONNECTIVES.findall(text)) + 2 * len(_CLAUSES.findall(text))),
        "unfamiliarity": sum(map(len, w)) / len(w) / 12.0 + sum(len(x) >= 9 for x in w) / len(w) if w else 0.0,
        "span": float(len(w)),
    }


def scored_of(named: list[dict], rows: list[dict], hits: list[Counter], listener: Listener) -> list[dict]:
    """``operators.concepts.raw_signals`` and ``score`` of one document."""
    where: dict[str, list[int]] = defaultdict(list)
    for k, here in enumerate(hits):
        for c in here:
            where[c].append(k)
    raw = []
    for c in named:
        at = where.get(c["concept_id"], [])
        crowds = [rows[k]["crowd"] for k in at if rows[k]["crowd"] is not None]
        raw.append(own_signals(c["canonical"], c["short_def"]) | {
            "reprise": float(sum(hits[k][c["concept_id"]] for k in at)), "density": sum(crowds) / len(crowds) if crowds else 0.0, "position": max((rows[k]["place"] for k in at), default=0.0), "author_signal": float(sum(bool(rows[k]["author"]) for k in at)),
            "evidence": float(len({rows[k]["ord"] for k in at if rows[k]["caption"]})), "connectedness": float(len({o for k in at for o in hits[k]} - {c["concept_id"]})),
        })
    for s in SIGNALS:
        low, high = min(r[s] for r in raw), max(r[s] for r in raw)
        flat = abs(high - low) <= 1e-9 * max(abs(high), abs(low))
        for r in raw:
            r[s] = 0.5 if flat else (r[s] - low) / (high - low)
    clamp = lambda x: min(1.0, max(0.0, x))
    out = []
    for c, r in zip(named, raw, strict=True):
        names = set(_BLANKS.split(c["canonical"].lower()))
        holds = lambda terms: any(set(t.lower().split()) <= names for t in terms)  # noqa: E731, B023
        domain = next((d for d, terms in listener.domain_terms.items() if terms and holds(terms)), None)
        factor = ops.EXPERTISE[listener.expertise.get(domain, listener.default_expertise) if domain is not None else listener.default_expertise]
        known = 0.15 if c["canonical"].lower() in {t.lower() for t in listener.known_terms} else 0.6 if holds(listener.known_terms) else 1.0
        difficulty = clamp(sum((r[s] * w for s, w in ops.DIFFICULTY.items()), 0.0) * factor * known)
        importance = clamp(sum((r[s] * w for s, w in ops.IMPORTANCE.items()), 0.0))
        signals = {s: float(Decimal(repr(r[s])).quantize(Decimal("0.001"), ROUND_HALF_EVEN)) for s in SIGNALS}
        out.append(c | {"difficulty": difficulty, "importance": importance, "budget": difficulty * importance, "signals": signals})
    return out


# ---------------------------------------------------------------- supports


def supports_of(rows: list[dict], hits: list[Counter], limit: float = 0.6) -> list[dict]:
    """``operators.concepts.supports`` and ``distinct_supports`` of one document."""
    by: dict[str, list[dict]] = defaultdict(list)
    for r, here in zip(rows, hits, strict=True):
        if r["supports"]:
            for c in here:
                by[c].append(r)
    bags: dict[int, set[str]] = {}
    out = []
    for c, said in by.items():
        kept: list[set[str]] = []
        for rank, r in enumerate(sorted(said, key=lambda r: (-r["order_score"], r["ord"], r["sent_ix"])), 1):
            bag = bags.get(id(r))
            if bag is None:
                bag = bags[id(r)] = set(_BAG.findall(r["text"].lower()))
            if not any((common := len(bag & b)) / max(len(bag) + len(b) - common, 1) > limit for b in kept):
                kept.append(bag)
                out.append({"concept_id": c, "rank": rank} | {x: r[x] for x in ("ord", "sent_ix", "text", "score", "definitional", "causal", "char_start", "char_end")})
    return out


def facts_of(rows: list[dict], headings: dict[int, str], listener: Listener) -> tuple[list[dict], list[dict], list[dict]]:
    """(sentences, concepts, supports) of a document, as the planner takes them, from its ``described`` sentences."""
    rows = sorted(rows, key=lambda r: (r["ord"], r["sent_ix"]))
    worded = [ops.tokens_of(r["text"]) for r in rows]
    named = candidates_of(rows)
    keyed = [(" ".join(ops.tokens_of(f)), c["concept_id"]) for c in named for f in {x.lower() for x in (c["canonical"], *c["aliases"])}]
    hits = hits_of(worded, keyed) if keyed else [Counter()] * len(rows)
    for r, here in zip(rows, hits, strict=True):
        if here:
            judge(r)
    stated = definitions_of(rows, worded, [c["canonical"] for c in named if c["short_def"] is None])
    concepts = []
    for c in scored_of(named, rows, hits, listener) if named else []:
        said, at = stated.get(c["canonical"], (None, None)) if c["short_def"] is None else (c["short_def"], None)
        concepts.append({x: c[x] for x in ("concept_id", "canonical", "difficulty", "importance", "budget", "signals", "first_ord")} | {"short_def": said, "def_at": at})
    sentences = [
        {"section_id": f"s_{0 if r['section'] is None else r['section']}", "section_title": headings.get(r["section"]) or "the text"} | {x: r[x] for x in ("ord", "sent_ix", "char_start", "char_end", "text")} | {"concept_ids": sorted(here)}
        for r, here in zip(rows, hits, strict=True)
    ]
    return sentences, concepts, supports_of(rows, hits)
