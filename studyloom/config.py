"""Profiles and listeners: settings that turn into literals of the plan."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Profile:
    name: str = "study"
    wpm: int = 155
    duration_multiplier: float = 1.4
    duration_floor_seconds: float = 600.0
    segment_min: float = 45.0
    segment_max: float = 90.0
    segment_hard_max: float = 120.0
    retrieval_min: float = 3.0
    retrieval_max: float = 6.0
    imagery_min: float = 2.0
    imagery_max: float = 4.0
    segment_pause: float = 1.2
    section_pause: float = 2.0
    min_gap_seconds: float = 180.0
    interval_ratio: float = 2.5
    repetitions_min: int = 2
    repetitions_max: int = 3
    max_concepts: int = 12
    max_analogies: int = 3
    max_anchors: int = 4
    anchor_abstractness: float = 0.5
    max_splits: int = 40
    prompts_per_segment: int = 1
    max_prequestions: int = 3
    max_preload: int = 7
    max_new_terms: int = 3
    emphasis_per_section: int = 1
    numeric_fidelity: str = "exact"
    significant_figures: int = 3
    citations: str = "suppress"

    def __post_init__(self) -> None:
        if not 80 <= self.wpm <= 270:
            raise ValueError(f"wpm must be between 80 and 270, not {self.wpm}")

    def seconds_for(self, text: str) -> float:
        return 60.0 * len(text.split()) / self.wpm


PROFILES = {
    "study": Profile(),
    "skim": Profile(name="skim", wpm=165, duration_multiplier=0.5, segment_min=40, segment_max=75, segment_hard_max=100, prompts_per_segment=0, repetitions_min=1, repetitions_max=1),
    "drill": Profile(name="drill", wpm=150, duration_multiplier=2.2, prompts_per_segment=2, repetitions_max=5),
}


@dataclass(frozen=True)
class Listener:
    name: str = "default"
    default_expertise: str = "novice"
    expertise: dict[str, str] = field(default_factory=dict)
    domain_terms: dict[str, list[str]] = field(default_factory=dict)
    known_terms: list[str] = field(default_factory=list)
    lexicon: dict[str, str] = field(default_factory=dict)

    def knows(self, term: str) -> bool:
        return term.lower() in {k.lower() for k in self.known_terms}

    def knows_part_of(self, term: str) -> bool:
        words = set(term.lower().split())
        return any(set(k.lower().split()) <= words for k in self.known_terms)

    def domain_of(self, term: str) -> str | None:
        words = set(term.lower().split())
        return next((d for d, terms in self.domain_terms.items() if any(set(t.lower().split()) <= words for t in terms)), None)

    def expertise_for(self, term: str) -> str:
        domain = self.domain_of(term)
        return self.expertise.get(domain, self.default_expertise) if domain else self.default_expertise


def _from_mapping(kind: type, values: dict[str, Any], base: Any = None) -> Any:
    unknown = set(values) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return replace(base, **values) if base is not None else kind(**values)


def _load(path: str) -> dict[str, Any]:
    try:
        import yaml
    except ImportError as error:  # JSON is a subset that needs no library
        if not path.endswith(".json"):
            raise RuntimeError("reading YAML settings needs the yaml library; use JSON instead") from error
        import json

        return json.loads(Path(path).read_text(encoding="utf-8"))
    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def load_profile(path: str) -> Profile:
    return _from_mapping(Profile, _load(path), Profile())


def load_listener(path: str) -> Listener:
    return _from_mapping(Listener, _load(path))
