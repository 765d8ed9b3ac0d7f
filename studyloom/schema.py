"""Closed vocabularies, table schemas and content-derived identifiers.

Every table starts with ``doc_id``; the document is the unit of parallelism.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA_VERSION = 1

# The closed vocabularies of the data model.
BLOCK_KINDS = "heading paragraph list_item figure table equation caption footnote code reference page_artifact unknown".split()
BLOCK_ROLES = "title authors affiliation abstract keywords introduction methods results discussion conclusion body references acknowledgement funding ethics appendix boilerplate unknown".split()
NON_CONTENT_ROLES = "affiliation keywords references acknowledgement funding ethics boilerplate".split()
TRIAGE_ACTIONS = "keep compress transform drop".split()
CONCEPT_KINDS = "term symbol quantity entity method claim unknown".split()
BEAT_TYPES = "orientation prequestion prequestion_close preload position exposition gloss anchor analogy elaboration emphasis prompt answer recap callback transition figure table equation review".split()
GENERATED_TYPES = "orientation prequestion prequestion_close preload position anchor analogy emphasis prompt recap transition review".split()
PROMPTING_TYPES = "prompt prequestion".split()
TEACHING_TYPES = "exposition gloss preload anchor analogy elaboration callback answer table figure equation".split()
PROMPT_TYPES = "definition mechanism distinction value recall".split()
EXPOSURE_FORMS = "statement prompt anchor recap callback review preload prequestion".split()
REGIONS = "opening body review".split()
SEVERITIES = "error warning".split()

BLOCKS = "doc_id bigint, ord int, kind string, role string, level int, page int, bbox struct<x0:double,y0:double,x1:double,y1:double>, text string"
SENTENCES = "doc_id bigint, ord int, sent_ix int, char_start int, char_end int, text string"
BEATS = "doc_id bigint, seq int, region string, section_id string, segment_ix int, beat_id string, type string, text string, concept_ids array<string>, est_seconds double, pause_after double, generated boolean, card_id string, spans array<struct<block:int,char_start:int,char_end:int>>"
CARDS = "doc_id bigint, card_id string, concept_id string, subject string, prompt string, answer string, prompt_type string, difficulty double, section_id string"
VIOLATIONS = "doc_id bigint, rule string, message string, excerpt string, severity string, beat_id string"
REVIEW_LOG = "card_id string, programme_id string, concept_id string, correct boolean, at timestamp, interval_days double, note string"

_SEPARATOR = "\x1f"


def digest(prefix: str, *parts: Column, length: int = 12) -> Column:
    """``prefix`` and the first hex digits of a SHA-256 over the parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(_SEPARATOR, *(p.cast("string") for p in parts)), 256), 1, length))


def block_id(kind: Column, page: Column, ord_: Column, text: Column) -> Column:
    return digest("b_", kind, F.coalesce(page.cast("string"), F.lit("")), ord_, F.substring(text, 1, 400))


def asset_id(block: Column, kind: Column, index: Column) -> Column:
    return digest("a_", block, kind, index)


def document_id(sha256: Column, adapter: Column) -> Column:
    return digest("d_", sha256, adapter)


def concept_id(canonical: Column) -> Column:
    return digest("c_", F.lower(canonical), length=10)


def beat_id(type_: Column, text: Column, salt: Column) -> Column:
    """``salt`` is the number of earlier beats with the same type and text."""
    return digest("t_", type_, text, salt)


def card_id(question: Column, salt: Column) -> Column:
    return digest("k_", F.lit("prompt"), question, salt)


def request_digest(*parts: Column) -> Column:
    return digest("", *parts, length=16)


def speech_key(engine: Column, text: Column) -> Column:
    return digest("s_", engine, text, length=32)
