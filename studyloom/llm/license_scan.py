"""License scans: an exact set-similarity join of text blocks with license templates.

A block is one line of a text; its set holds the distinct words (ASCII letters folded).  A block
meets a template when it contains at least ``threshold`` of the template's distinct words.  Notices
wrapped over several lines are blocks too: neighbouring lines in which a run of at most ``RUN`` times the
template's words contains that share, unless one of the lines meets the template by itself; of runs
that overlap the one with the most words counts, numbered by its first line.  The
template tokens are put in one global order, rarest in the corpus first, and three exact filters
run before a pair is verified:

* prefix: with ``need = ceil(threshold * |T|)``, a qualifying block holds one of the ``|T| - need + 1``
  rarest tokens of T, so only those are indexed;
* length: a block with fewer than ``need`` template-vocabulary words cannot qualify;
* position: from the first shared token on, ``1 + min(rest of T, rest of the block)`` bounds the overlap.

The corpus side never shuffles: the frequency pass emits one partial count per template token and
task, and the index (bounded by the template list, a parameter) travels with the task closure.

Defined cases: null text is the empty text (one empty block, no words); repeated rows and null ids
give one output row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.common import small_batches

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases whose consecutive words mark a license, with their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: (label, notice) pairs: public license notices and the short forms that stand in texts.
TEMPLATES = [
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "released under the bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

THRESHOLD = 0.92
#: Words in a run over several lines, as a multiple of the template's.
RUN = 1.5

MATCH = "array<struct<block:int,label:string,overlap:int,size:int,containment:double,text:string>>"
PLACES = "array<struct<label:string,first:bigint,last:bigint>>"


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall((text or b"").lower())


def template_sets(templates) -> list[tuple[str, frozenset[bytes]]]:
    return [(label, frozenset(words_of(text.encode()))) for label, text in templates]


def token_frequencies(df: DataFrame, text_col: str, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """Occurrences in the whole corpus of each template token (one partial row per token and task)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                found = Counter(words_of(text))
                for token in vocabulary & found.keys():
                    total[token] += found[token]
        if total:
            yield pa.RecordBatch.from_pydict({"token": [t.decode() for t in total], "n": list(total.values())}, schema=pa.schema([("token", pa.string()), ("n", pa.int64())]))

    partial = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "token string, n bigint")
    return {r.token.encode(): r.n for r in partial.groupBy("token").agg(F.sum("n").alias("n")).collect()}  # at most |vocabulary| rows


class TemplateIndex:
    """Prefix index over the templates under one global token order."""

    def __init__(self, templates, frequencies: dict[bytes, int], threshold: float):
        self.threshold = threshold
        self.sets = template_sets(templates)
        vocabulary = sorted(frozenset().union(*(s for _, s in self.sets)) if self.sets else (), key=lambda t: (frequencies.get(t, 0), t))
        self.rank = {t: i for i, t in enumerate(vocabulary)}
        self.ordered = [sorted(s, key=self.rank.__getitem__) for _, s in self.sets]
        self.need = [math.ceil(threshold * len(s) - 1e-9) for _, s in self.sets]
        self.index: dict[bytes, list[tuple[int, int]]] = {}
        for k, tokens in enumerate(self.ordered):
            for i, token in enumerate(tokens[: len(tokens) - self.need[k] + 1]):
                self.index.setdefault(token, []).append((k, i))
        self.prefix_tokens = frozenset(self.index)
        self.run = [math.ceil(RUN * len(words_of(text.encode()))) for _, text in templates]

    def match(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(template, overlap) of every template that the block's words contain to the threshold."""
        if self.prefix_tokens.isdisjoint(words):
            return []
        rank = self.rank
        block = sorted({w for w in words if w in rank}, key=rank.__getitem__)
        held, done, out = frozenset(block), set(), []
        for j, token in enumerate(block):
            for k, i in self.index.get(token, ()):
                if k in done:
                    continue
                done.add(k)
                need, size = self.need[k], len(self.ordered[k])
                if len(block) < need or 1 + min(size - i - 1, len(block) - j - 1) < need:
                    continue
                overlap = len(held & self.sets[k][1])
                if overlap >= need:
                    out.append((k, overlap))
        return out


    def match_lines(self, lines: list[list[bytes]], alone: set[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """(template, overlap, first line, last line) of templates met by runs over several lines; ``alone`` has (template, line) of lines that do by themselves."""
        words = [w for line in lines for w in line]
        held, out, of_line = frozenset(words), [], None
        for k in sorted({k for t in self.prefix_tokens & held for k, _ in self.index[t]}):
            need, wanted = self.need[k], self.sets[k][1]
            if len(held & wanted) < need:
                continue
            of_line = of_line or [n for n, line in enumerate(lines) for _ in line]
            spots, inside, left, best = [i for i, w in enumerate(words) if w in wanted], Counter(), 0, None
            for i in spots:
                inside[words[i]] += 1
                while i - spots[left] >= self.run[k] or inside[words[spots[left]]] > 1:
                    inside[words[spots[left]]] -= 1
                    if not inside[words[spots[left]]]:
                        del inside[words[spots[left]]]
                    left += 1
                start, first, last = spots[left], of_line[spots[left]], of_line[i]
                if len(inside) < need or first == last or any((k, n) in alone for n in range(first, last + 1)):
                    continue
                if best and start <= best[1]:  # overlaps the last run found
                    best = max(best, (len(inside), i, start, first, last), key=lambda b: (b[0], b[2] - b[1]))
                    continue
                if best:
                    out.append((k, best[0], best[3], best[4]))
                best = (len(inside), i, start, first, last)
            if best:
                out.append((k, best[0], best[3], best[4]))
        return out


def phrase_places(words: list[bytes], phrases: list[tuple[tuple[bytes, ...], str]]) -> list[tuple[str, int, int]]:
    out = []
    for phrase, label in phrases:
        at, size = -1, len(phrase)
        while True:
            try:
                at = words.index(phrase[0], at + 1)
            except ValueError:
                break
            if tuple(words[at : at + size]) == phrase:
                out.append((label, at, at + size - 1))
    return out


def scan_licenses(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", templates=TEMPLATES, base_phrases=BASE_PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: (id, n_words, places, matches); matches carry the block's text."""
    small_batches(df.sparkSession)
    vocabulary = frozenset().union(*(s for _, s in template_sets(templates))) if templates else frozenset()
    index = TemplateIndex(templates, token_frequencies(df, text_col, vocabulary), threshold)
    phrases = [(tuple(words_of(p.encode())), label) for p, label in base_phrases.items()]
    place_type = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
    match_type = pa.list_(pa.struct([("block", pa.int32()), ("label", pa.string()), ("overlap", pa.int32()), ("size", pa.int32()), ("containment", pa.float64()), ("text", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, places, matches = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = words_of(text)
                n_words.append(len(words))
                places.append([{"label": a, "first": b, "last": c} for a, b, c in phrase_places(words, phrases)])
                found = []
                if not index.prefix_tokens.isdisjoint(words):
                    lines = (text or b"").split(b"\n")
                    split = [words_of(line) for line in lines]
                    met = [(k, overlap, number, number) for number, line in enumerate(split) for k, overlap in index.match(line)]
                    met += index.match_lines(split, {(k, number) for k, _, number, _ in met}) if len(lines) > 1 else []
                    for k, overlap, first, last in met:
                        size = len(index.ordered[k])
                        found.append({"block": first, "label": index.sets[k][0], "overlap": overlap, "size": size, "containment": overlap / size, "text": b"\n".join(lines[first : last + 1]).decode("utf-8", "replace")})
                matches.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(places, place_type), pa.array(matches, match_type)], names=["id", "n_words", "places", "matches"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(scan, f"id {id_type}, n_words bigint, places {PLACES}, matches {MATCH}").withColumnRenamed("id", id_col)


def license_report(df: DataFrame, **options) -> DataFrame:
    """The digest of ``scan_licenses``: counts, first and last words, label lists and a score."""
    scanned = scan_licenses(df, **options)
    id_col = options.get("id_col", "doc_id")
    base, own = F.transform("places", lambda p: p["label"]), F.transform("matches", lambda m: m["label"])
    best = F.array_max(F.transform("matches", lambda m: m["containment"]))
    return scanned.select(
        F.col(id_col),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["first"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
        F.size(F.array_distinct(F.transform("matches", lambda m: m["block"]))).cast("long").alias("n_blocks"),
    )


def oracle() -> str:
    """DuckDB: the same join by brute force over every (line, template) pair; runs over several lines are beyond it."""
    fold = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = ", ".join(f"({[w.decode() for w in words_of(p.encode())]}, '{label}')" for p, label in BASE_PHRASES.items())
    rows = ", ".join(f"({sorted(w.decode() for w in s)}, '{label}')" for label, s in template_sets(TEMPLATES))
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {fold} AS low FROM documents),
w AS (SELECT doc_id, rid, low, regexp_extract_all(low, '{pattern}') AS ws FROM d),
phrase(words, label) AS (VALUES {phrases}),
tpl(words, label) AS (VALUES {rows}),
starts AS (SELECT rid, label, i - 1 AS pos FROM (SELECT rid, ws, words, label, unnest(range(1, len(ws) + 1)) AS i FROM w, phrase)
           WHERE ws[i] = words[1] AND ws[i : i + len(words) - 1] = words),
base AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM starts GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(low, chr(10))) AS line, generate_subscripts(string_split(low, chr(10)), 1) AS b FROM w),
blocks AS (SELECT rid, b, regexp_extract_all(line, '{pattern}') AS ws FROM lines),
pairs AS (SELECT rid, b, label, len(list_intersect(ws, words)) / len(words)::DOUBLE AS c FROM blocks, tpl
          WHERE list_has_any(ws, words) AND len(list_intersect(ws, words)) >= ceil({THRESHOLD} * len(words) - 1e-9)),
own AS (SELECT rid, list(DISTINCT label) AS labels, max(c) AS c, count(DISTINCT b) AS n_blocks FROM pairs GROUP BY rid)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(own.c, 0.0) END::DOUBLE AS score, coalesce(n_blocks, 0)::BIGINT AS n_blocks
FROM w LEFT JOIN base USING (rid) LEFT JOIN own USING (rid)
"""
