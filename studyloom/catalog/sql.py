"""SQL fragments that the oracles share; they say the same as the column helpers."""

from __future__ import annotations


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(words: list[str]) -> str:
    return "(" + ", ".join(map(quoted, words)) + ")"


def spaced(t: str) -> str:
    return f"replace(coalesce({t}, ''), chr(160), ' ')"


def bare(t: str) -> str:
    return rf"regexp_replace({spaced(t)}, '^\s+|\s+$', '', 'g')"


def word_count(t: str) -> str:
    return rf"(CASE WHEN {bare(t)} = '' THEN 0 ELSE len(string_split_regex({bare(t)}, '\s+')) END)"


def words(t: str) -> str:
    return rf"(CASE WHEN {bare(t)} = '' THEN []::VARCHAR[] ELSE string_split_regex({bare(t)}, '\s+') END)"


def sentences(t: str) -> str:
    return rf"list_filter(string_split(regexp_replace(coalesce({t}, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')"


def tokens(t: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({t}, '')), '[a-z][a-z0-9''_-]*')"


def ngrams(t: str, n: int) -> str:
    return f"(CASE WHEN len({t}) >= {n} THEN list_transform(range(1, len({t}) - {n - 2}), lambda i: array_to_string({t}[i : i + {n - 1}], ' ')) ELSE []::VARCHAR[] END)"


LINES = f"""lines AS (SELECT doc_id, ord - 1 AS ord, text FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text,
  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ord FROM documents) WHERE trim({spaced('text')}) <> '')"""

SENTENCES = f"""sents AS (SELECT doc_id, ord, k - 1 AS sent_ix, text FROM (SELECT doc_id, ord, unnest({sentences('text')}) AS text, generate_subscripts({sentences('text')}, 1) AS k FROM lines))"""
