"""Every training-data operator against a brute-force version and on the odd inputs its docstring names."""

import gzip
import hashlib
import io
import random
import re
import struct
import textwrap
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyloom.llm import bpe, decontam, embed_dedup, graph, html_extract, langid, license_scan, ngram_join, token_counts, toxicity, warc
from studyloom.llm.queries import VOCABULARY

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, score string, b string, label string, w string, h string"


def docs(spark, texts, **more):
    """Documents with nulls in the other columns and with columns whose names clash with inner ones."""
    rows = [(i, t, None, None, None, "x", "y", "z", "q", "w", "h") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (None, "a null id with some words here"), (5, "same text twice with a few words"), (5, "same text twice with a few words"), (6, "x" * 200_000), (7, "word " * 50_000)]


def components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ---------------------------------------------------------------- 1 licenses


def test_license_scan_finds_templates_by_containment_and_phrases_by_place(spark):
    texts = [
        (1, "Some words.\nThis work is licensed under the GNU General Public License, version 3.\nMore"),
        (2, "Released under the MIT License"),
        (3, "licensed under the apache licence version two"),
        (4, "permission is granted free of charge to any person who obtains a copy of this software and the associated documentation files hereby"),
        (5, "plain prose about a license of no kind"),
    ]
    rows = {r.doc_id: r for r in license_scan.license_report(docs(spark, texts)).collect()}
    assert rows[1].base_labels == "gpl" and rows[1].labels == "gpl,gpl-3.0" and rows[1].n_base == 1 and rows[1].first_word == rows[1].last_word == 8
    assert rows[2].base_labels == "mit" and rows[2].score == 1.0
    assert rows[4].labels == "mit" and rows[4].n_base == 0 and rows[4].first_word is None and 0.92 <= rows[4].score < 1
    assert rows[5].labels == "" and rows[5].score == 0


def test_template_filters_lose_no_match():
    rng = random.Random(3)
    words = sorted({w for _, s in license_scan.template_sets(license_scan.TEMPLATES) for w in s})
    index = license_scan.TemplateIndex(license_scan.TEMPLATES, {w: rng.randint(0, 9) for w in words}, 0.7)
    for _ in range(400):
        base = rng.choice(index.sets)[1]
        block = [w for w in base if rng.random() < 0.85] + rng.sample(words, 5)
        brute = {(k, len(s & set(block))) for k, (_, s) in enumerate(index.sets) if len(s & set(block)) >= index.need[k]}
        assert set(index.match(block)) == brute


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above notice appears in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_license_scan_reads_wrapped_notices(spark, mark):
    texts = []
    for width in (40, 60, 75):
        for label, notice in WRAPPED.items():
            body = "\n".join(mark + line for line in textwrap.wrap(notice, width))
            texts.append((len(texts), f"Some file.\n{body}\nThe code follows.", label))
    apart = "released some words\n" + "plain words of prose stand here\n" * 3 + "under the\n" + "more of it\n" * 3 + "bsd and its license"
    rows = {r.doc_id: r for r in license_scan.license_report(docs(spark, [(i, t) for i, t, _ in texts] + [(900, apart)])).collect()}
    assert [(i, label) for i, _, label in texts if label not in rows[i].labels.split(",")] == []
    assert all(rows[i].n_blocks >= 1 and rows[i].score >= license_scan.THRESHOLD for i, _, _ in texts) and rows[900].labels == ""


def test_license_scan_takes_odd_rows(spark):
    rows = license_scan.license_report(docs(spark, ODD)).collect()
    assert len(rows) == len(ODD) and {r.n_words for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert license_scan.license_report(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- 2 toxicity and 8 language


def labelled(spark, n=400):
    rng = random.Random(11)
    words = ["plain", "table", "river", "stone", "quiet", "cloud", "paper", "green"]
    rows, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        text = [rng.choice(words) for _ in range(30)]
        if bad:
            text[rng.randrange(30)] = rng.choice(["idiot", "scum"])
        rows.append((k, " ".join(text)))
        labels.append((k, 1, int(bad)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_holds_out_its_fold_and_generalises(spark):
    data, labels = labelled(spark)
    got = toxicity.toxicity_report(data, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in got if r.held_out]
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_toxicity_takes_odd_rows_and_missing_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity_report(docs(spark, ODD), none).collect()} == {0.0}
    strange = spark.createDataFrame([(1, None, None), (None, 1, 1), (5, 1, 1), (5, 1, 0), (7, 0, 0), (4, 0, 0), (6, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert len(toxicity.toxicity_report(docs(spark, ODD), strange).collect()) == len(ODD)
    assert toxicity.toxicity_report(docs(spark, []), strange).count() == 0


def test_samples_keep_to_their_bound_whatever_repeats(spark):
    rows = [(k % 40, f"text {k}") for k in range(4000)] + [(7, "the same text") for _ in range(2000)]
    data = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in rows] + [(900 + k, "w", f"x{k}") for k in range(30)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k % 40, 1, k % 3 % 2) for k in range(5000)], "doc_id bigint, quality int, toxic int")
    chosen = toxicity.sample(data, labels, "toxic", "text", "doc_id", 5).collect()
    assert 0 < len(chosen) <= 10 and len({r.id for r in chosen}) == len(chosen)
    chosen = langid.sample(data, "text", "lang", "doc_id", 5, most_langs=2).collect()
    assert {r.label for r in chosen} <= {"en", "de"} and 0 < len(chosen) <= 10
    everything = langid.sample(data, "text", "lang", "doc_id", 1000).collect()
    import zlib

    assert {(r.id, r.label) for r in everything} == {(r.doc_id, r.lang) for r in data.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}


def plain_ftrl(rows, alpha=0.3, beta=1.0, l1=4.0, l2=1.0, epochs=3):
    """FTRL-proximal written out coordinate by coordinate."""
    z, n, zb, nb = {}, {}, 0.0, 0.0
    weight = lambda k: 0.0 if abs(z.get(k, 0.0)) <= l1 else -(z[k] - (l1 if z[k] > 0 else -l1)) / ((beta + n[k] ** 0.5) / alpha + l2)
    order = np.random.default_rng(17)
    for _ in range(epochs):
        for j in order.permutation(len(rows)):
            features, y = rows[j]
            w = {k: weight(k) for k in features}
            b = -zb / ((beta + nb**0.5) / alpha)
            g = 1 / (1 + np.exp(-(sum(w.values()) + b))) - y
            for k in features:
                old = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / alpha * w[k]
                n[k] = old + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * b
            nb += g * g
    return {k: weight(k) for k in z if weight(k)}, -zb / ((beta + nb**0.5) / alpha)


def test_ftrl_weights_equal_a_plain_loop(spark):
    data, labels = labelled(spark, 200)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    texts, marks = zip(*[(r.text, truth[r.doc_id]) for r in data.collect()], strict=True)
    model = toxicity.train(list(texts), list(marks))
    want, bias = plain_ftrl([({int(k) for k in toxicity.feature_slots(toxicity.word_hashes(t))}, y) for t, y in zip(texts, marks, strict=True)])
    assert dict(zip(model.slots.tolist(), model.weights.tolist(), strict=True)) == pytest.approx(want, rel=1e-4, abs=1e-5) and model.intercept == pytest.approx(bias)


LANGS = {"en": "the of and to in is was for with that", "de": "der die und zu in ist war für mit dass", "fr": "le la de et à est été pour avec que"}


def test_language_id_learns_and_calls_letterless_texts_undetermined(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(LANGS[lang].split()) for _ in range(12)), lang) for k in range(300) for lang in [list(LANGS)[k % 3]]]
    data = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 34 !!", "en"), (902, "", None), (None, "der die und", "de")], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in langid.language_report(data).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert held and sum(got[k].lang_pred == lang for k, _, lang in held) >= 0.95 * len(held)
    assert {got[k].lang_pred for k in (900, 901, 902)} == {"und"} and got[None].lang_pred == "de"
    assert langid.language_report(data.limit(0)).count() == 0
    unlabelled = docs(spark, ODD)
    assert {r.lang_pred for r in langid.language_report(unlabelled).collect()} == {"und"}


def test_language_parts_count_every_ngram_once():
    whole = "".join(random.Random(1).choice("abc é") for _ in range(1000))
    size, langid.PART_CHARS = langid.PART_CHARS, 37
    try:
        parts = np.concatenate(list(langid.parts_of(whole)))
    finally:
        langid.PART_CHARS = size
    assert sorted(parts) == sorted(np.concatenate(list(langid.parts_of(whole))))


def test_temperature_cools_overconfident_logits():
    rng = np.random.default_rng(2)
    truth = rng.integers(0, 3, 500)
    logits = np.eye(3)[np.where(rng.random(500) < 0.7, truth, rng.integers(0, 3, 500))] * 12
    assert langid.temperature(logits, truth) > 2


# ---------------------------------------------------------------- 3 decontamination


def test_decontamination_finds_copies_and_reparameterised_questions(spark):
    item = "A train leaves the old station at 40 km per hour and meets Ann after 3 hours on the long bridge near the quiet town"
    items = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (4, item), (5, "Seven words make up this short item")], "item_id bigint, text string")
    texts = [
        (1, f"Intro words here. {item}. Some more words"),
        (2, item.replace("40", "75").replace("Ann", "Bo").replace("3 hours", "9 hours")),
        (3, item.replace("old station", "new airport").replace("long bridge", "short road").replace("leaves", "enters")),
        (4, "an unrelated text about a train that leaves the station at some hour of the day"),
        (5, "He said: seven words make up this short item again"),
        *[(i + 10 if i else None, t) for i, t in ODD],
    ]
    got = {(r.doc_id, r.item_id): r for r in decontam.matches(docs(spark, texts), items).collect()}
    assert got[1, 1].kind == "exact" and (1, 4) in got
    assert got[2, 1].kind == "reparameterised" and got[2, 1].n_slots >= 3
    assert (5, 5) in got and {d for d, _ in got} == {1, 2, 5}
    assert decontam.matches(docs(spark, []), items).count() == 0 and decontam.matches(docs(spark, texts), items.limit(0)).count() == 0


def test_decontamination_asks_for_consistent_slots(spark):
    item = "Add 5 apples and 5 pears then give 5 plums and 5 grapes to the 5 cousins who came with 5 baskets"
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    once = iter(range(20, 40))
    mixed = re.sub("5", lambda m: str(next(once)), item)
    got = decontam.matches(docs(spark, [(1, item.replace("5", "8")), (2, mixed)]), items).collect()
    assert [(r.doc_id, r.kind) for r in got] == [(1, "reparameterised")]


def test_decontamination_finds_other_names_at_the_start_of_sentences(spark):
    item = "Ann has 5 apples. Ben has 3 pears. Ann buys 4 more apples.\nBen eats 2 of the pears. \"Ann Lee, how many do we hold now?\" asks Ben. Ann counts them all."
    short = "Ann sells 7 red boats every day"
    other = item.replace("Ann", "Zoe").replace("Ben", "Tom").replace("5", "11").replace("3", "8")
    items = spark.createDataFrame([(1, item), (2, short)], "item_id bigint, text string")
    names = iter("Zoe Tom Kim Max Joe Amy Sue Roy Liz Ned".split())
    texts = [(1, other), (2, f"Some words. {other}"), (3, short.replace("Ann", "Bob").replace("7", "9")), (4, item), (5, re.sub("Ann|Ben", lambda m: next(names), item)), (6, f"He said: {short.lower()}")]
    got = {(r.doc_id, r.item_id): r.kind for r in decontam.matches(docs(spark, texts), items).collect()}
    assert got == {(1, 1): "reparameterised", (2, 1): "reparameterised", (3, 2): "reparameterised", (4, 1): "exact", (6, 2): "exact"}


def test_decontamination_asks_for_slots_that_differ_where_the_item_has_them(spark):
    items = spark.createDataFrame([(1, "she buys 5 apples and 3 pears for the long trip"), (None, "give 4 of the boxes back to them now")], "item_id bigint, text string")
    texts = [(1, "she buys 7 apples and 7 pears for the long trip"), (2, "she buys 7 apples and 6 pears for the long trip"), (3, "give 9 of the boxes back to them now")]
    assert sorted((r.doc_id, r.item_id) for r in decontam.matches(docs(spark, texts), items).collect()) == [(2, 1), (3, None)]


def test_decontamination_matches_very_short_items_as_whole_texts(spark, monkeypatch):
    items = spark.createDataFrame([(1, "Too short"), (2, "Add 5"), (3, "...")], "item_id bigint, text string")
    texts = [(1, "too short."), (2, "this is too short to count"), (3, "add 5"), (4, "Add 6"), (5, None), (6, "")]
    for few in (decontam.BROADCAST_ROWS, 0):
        monkeypatch.setattr(decontam, "BROADCAST_ROWS", few)
        assert sorted((r.doc_id, r.item_id, r.kind) for r in decontam.matches(docs(spark, texts), items).collect()) == [(1, 1, "exact"), (3, 2, "exact")]


def brute_contamination(texts, items):
    """Every (text, item) pair, every offset, with token lists made by another engine's expressions."""
    import regex

    def forms(text):
        text = regex.sub(r"[.,](?<=\d[.,])(?=\d)", "\x02", text)
        for before in (r"(?<=[\p{L}\p{N},;] {1,2})", r"(?<![\p{L}\p{N}])"):
            out = regex.sub(before + r"(?=\p{Lu})", "\x01", text)
            out = regex.sub("(?<=\x01\\p{L}{1,40}) (?=\x01)", "\x02", out).lower()
            out = regex.sub(r"(?<=\d)\s?(?=(?:" + "|".join(decontam.UNITS) + r")(?![\p{L}\p{N}]))", " \x03", out)
            words = [w for w in regex.split("[^\\p{L}\\p{N}\x01\x02\x03]+", out) if w]
            yield words, [{"\x01": "NAME", "\x03": "UNIT"}.get(w[0], "NUMBER" if w[0].isdigit() and w[0].isascii() else w) for w in words]

    found = {}
    for i, item in items:
        for d, text in texts:
            for (iw, ih), (tw, th) in zip(forms(item), forms(text), strict=True):
                size = min(len(ih), decontam.WINDOW)
                spots = [(k, sum(h in ("NAME", "UNIT", "NUMBER") for h in ih[k : k + size])) for k in range(len(ih) - size + 1)]
                most = min(decontam.MIN_LITERALS, max(size - n for _, n in spots))
                evidence = [k for k, n in spots if size - n >= most]
                covered, pairs = set(), set()
                for offset in range(-len(ih), len(th)):
                    hit = [k for k in evidence if k + offset >= 0 and th[k + offset : k + offset + size] == ih[k : k + size]]
                    used = {(iw[j], tw[j + offset]) for k in hit for j in range(k, k + size) if ih[j] in ("NAME", "UNIT", "NUMBER")}
                    if hit and len({a for a, _ in used}) == len(used) == len({b for _, b in used}):
                        covered |= set(hit)
                        pairs |= used
                if len(covered) / len(evidence) >= decontam.COVERAGE:
                    found[d, i] = (len(covered), len(evidence), "exact" if all(a == b for a, b in pairs) else "reparameterised")
                    break
    return found


@pytest.mark.parametrize("few", [2_000_000, 0])
def test_decontamination_equals_a_search_of_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", few)
    rng = random.Random(21)
    names, words = ["Ann", "Ben", "Zoe", "Tom", "Kim"], "buys sells red old boats apples near the river and town of long after every day".split()
    fill = lambda t: re.sub("N", lambda m: rng.choice(names), re.sub("#", lambda m: str(rng.randint(2, 9)), t))
    plans = [" ".join(rng.choice([*words, *words, "N", "# km", "#", "."]) for _ in range(rng.randint(5, 30))).replace(" .", ".") for _ in range(25)]
    items = [(k, fill(p)) for k, p in enumerate(plans) if len(re.findall(r"\w+", p)) >= 6]
    texts = []
    for k in range(120):
        body = [rng.choice(words) for _ in range(rng.randint(0, 20))]
        for _ in range(rng.randint(0, 2)):
            part = rng.choice([fill(rng.choice(plans)), rng.choice(items)[1]]).split()
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = rng.choice(words)
            body += part + [rng.choice(words) for _ in range(4)]
        texts.append((k, " ".join(body)))
    got = {(r.doc_id, r.item_id): (r.n_windows, r.item_windows, r.kind) for r in decontam.matches(docs(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = brute_contamination(texts, items)
    assert got == want and {k for _, _, k in want.values()} == {"exact", "reparameterised"}


# ---------------------------------------------------------------- 4 WARC


def test_warc_round_trip_and_revisits(spark, tmp_path):
    body = "<p>" + "é" * 80 + "</p>\r\n\r\nWARC/1.1\r\n\r\n"
    rows = [(3, "http://a/x\r\ny", body), (1, None, body), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", body), (1, None, body), (9, "u", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, digest string, payload string")
    path = warc.write_archives(pages, f"file://{tmp_path}/w")
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    kinds = sorted((r.page_id or "", r.record_type, r.refers_to or "") for r in got)
    assert kinds == sorted([("3", "revisit", "1"), ("1", "response", ""), ("1", "response", ""), ("2", "response", ""), ("4", "response", ""), ("5", "response", ""), ("", "response", ""), ("9", "response", "")])
    revisit = next(r for r in got if r.page_id == "3")
    assert revisit.payload is None and revisit.payload_bytes == len(body.encode()) and revisit.payload_digest == hashlib.sha256(body.encode()).hexdigest()
    assert bytes(next(r for r in got if r.page_id == "1").payload) == body.encode()
    assert warc.archive_report(pages.limit(0), f"file://{tmp_path}/empty").count() == 0


def test_warc_archives_are_bounded_by_bytes(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"{k} " + "z" * 20_000) for k in range(200)], "page_id bigint, url string, html string")
    path = warc.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=100_000)
    sizes = [len(gzip.open(f).read()) for f in (tmp_path / "w").glob("part-*")]
    assert sum(sizes) > 4_000_000 and max(sizes) < 400_000 and warc.read_archives(spark, path).count() == 200


def test_warc_parser_reads_by_length():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 12\r\n\r\nWARC/1.1\r\n\r\n\r\n\r\n"
    found = list(warc.parse_records(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(record * 3)))))
    assert len(found) == 3 and found[0][1] == b"WARC/1.1\r\n\r\n"
    with pytest.raises(ValueError):
        list(warc.parse_records(io.BytesIO(b"garbage\r\n\r\n")))


# ---------------------------------------------------------------- 5 BPE


def library(text):
    return bpe.Codec.of(VOCABULARY).tokenizer.encode(text or "", add_special_tokens=False).ids


def odd_texts():
    rng = random.Random(8)
    bits = ["a", "the", " ", "  ", "\n", "'", "'s", "12", "é", "ß", "<|endoftext|>", "<|", "|>", "endoftext", "日本", "😀", "!!", "\x00", "\x1c", " "]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 120))) for _ in range(300)] + ["a" * 999, " " * 500, "'" * 300, "é" * 200, "", "ab" * 400, "1" * 333]


@pytest.mark.parametrize("leaf", [1, 3, 11, 64])
def test_tree_joins_equal_the_library(leaf):
    codec = bpe.Codec.of(VOCABULARY)
    for text, ids in zip(odd_texts(), codec.encode_all(odd_texts(), leaf), strict=True):
        assert ids.tolist() == library(text) and codec.decode(ids) == text


def test_bpe_over_tasks_equals_the_library(spark):
    texts = [*ODD, (20, "a" * 5_000), (21, "mixed 'text' with 123 " * 400), (22, "x <|endoftext|> y" * 50), *((30 + k, t * 40) for k, t in enumerate(odd_texts()[:60]))]
    got = bpe.encode_texts(docs(spark, texts), VOCABULARY, leaf_chars=64, task_chars=1000).collect()
    want = sorted((str(i), len(library(t)), hashlib.sha256(struct.pack(f"<{len(library(t))}I", *library(t))).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want and all(r.same for r in got)
    assert bpe.encode_texts(docs(spark, []), VOCABULARY).count() == 0


# ---------------------------------------------------------------- 6 n-gram join


def brute_classes(texts):
    sets = {}
    for i, t in texts:
        w = re.sub("[A-Z]", lambda m: m.group(0).lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links = [(a, b) for a, b in combinations([i for i in sets if i is not None], 2) if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b])]
    return components(links, [i for i in sets if i is not None])


def family_texts(n=160, seed=4):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    out = []
    for k in range(n):
        if k % 3 == 0 or not out:
            text = [rng.choice(words) for _ in range(rng.randint(6, 120))]
            if k % 2:
                text[3:3] = passage
        else:
            text = rng.choice(out)[1].split()
            for _ in range(rng.randint(0, max(1, len(text) // 25))):
                text[rng.randrange(len(text))] = rng.choice(words)
        out.append((k * 7 % 1009, " ".join(text)))
    return out


def test_near_duplicate_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 3)
    texts = [*family_texts(), *[(i + 2000 if i else None, t) for i, t in ODD]]
    got = ngram_join.near_duplicates(docs(spark, texts).repartition(5)).collect()
    want = brute_classes(texts)
    assert len(got) == len(texts)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want and all(r.component_id is None for r in got if r.doc_id is None)
    assert {r.n_shingles for r in got if r.doc_id in (2001, 2002, 2003)} == {0} and {r.n_shingles for r in got if r.doc_id == 2004} == {1}
    assert ngram_join.near_duplicates(docs(spark, [])).count() == 0


def test_long_lists_lose_no_pair_and_keep_to_their_filters(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 2)
    monkeypatch.setattr(ngram_join, "FREQUENT_LEAST", 10_000)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "TASK_BLOCK", 7)
    monkeypatch.setattr(ngram_join, "NEIGHBOURS", 0)
    monkeypatch.setattr(ngram_join, "NEAREST_STEP", 3)
    monkeypatch.setattr(ngram_join, "KEPT_PAIRS", 5)
    texts = family_texts(120, 9)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs(spark, texts)).collect()}
    assert got == brute_classes(texts)


def test_ids_with_several_sets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 2)
    monkeypatch.setattr(ngram_join, "FREQUENT_LEAST", 10_000)
    rng = random.Random(31)
    common = [f"c{k}" for k in range(25)]
    make = lambda n: " ".join(common + [f"x{rng.randint(0, 10**6)}" for _ in range(n)])
    texts = [(1, make(40)), (1, "short " + " ".join(common))] + [(2 + k, f"v{k} " + " ".join(common)) for k in range(9)] + [(20, make(30)), (20, make(60)), (21, ""), (21, make(30))]
    got = ngram_join.near_duplicates(docs(spark, texts)).collect()
    want = brute_classes(texts)
    assert len(got) == len(texts) and all(r.component_id == want[r.doc_id] for r in got) and want[10] == 1
    with pytest.raises(TypeError):
        ngram_join.near_duplicates(docs(spark, texts), id_col="id")


def test_a_hot_list_and_a_hot_copy_keep_to_small_tasks(spark, monkeypatch):
    """A passage in every text, one text copied to a third of all rows, and a third of near copies."""
    monkeypatch.setattr(ngram_join, "TASK_BLOCK", 64)
    rng = random.Random(41)
    passage = " ".join(f"p{k}" for k in range(12))
    word = lambda: f"w{rng.randint(0, 10**6)}"
    base = [word() for _ in range(60)]
    near = [" ".join([*base[:40], *(word() for _ in range(2)), *base[42:]]) for _ in range(300)]
    texts = [(k, f"{passage} one and the same text of all of these") for k in range(300)] + [(300 + k, t) for k, t in enumerate(near)] + [(600 + k, f"{passage} " + " ".join(word() for _ in range(3))) for k in range(300)]
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs(spark, texts)).collect()}
    assert got == brute_classes(texts)


def test_nearest_candidates_are_linear_in_the_sets():
    rng = np.random.default_rng(5)
    pairs = np.array([(i, j, rng.integers(0, 50)) for i in range(60) for j in range(i)])
    kept = ngram_join.nearest(pairs, 2)
    assert len(kept) <= 4 * 60 and len(ngram_join.nearest(pairs, 60)) == len(pairs)
    for end in range(60):
        mine = pairs[(pairs[:, 0] == end) | (pairs[:, 1] == end)]
        assert mine[:, 2].max() in kept[(kept[:, 0] == end) | (kept[:, 1] == end)][:, 2]


def test_sketch_distance_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, rng.integers(0, 300), dtype=np.uint64)]))
        if len(b):
            assert ngram_join.sketch_distance(ngram_join.sketch_of(a), ngram_join.sketch_of(b)) <= len(np.setxor1d(a, b))


def test_connected_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 150)] + [(200, 201), (201, 202), (202, 200)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = components(edges, {n for e in edges for n in e if e[0] != e[1]})
    assert got == want
    assert graph.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---------------------------------------------------------------- 7 HTML


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a>Menu</a></ul></nav>
<div class="ad">Buy now<article class="post"><h1>Big &amp; small</h1><p>First <b>bold
text</b> of the article.<p>Second&nbsp;line<br>goes on</p><script>var x="</p>";</script><!-- note --><aside>See also</aside><form><input>Search</form>
<blockquote>Quoted words.</blockquote><section id="comments"><article><p>A reader says hi.</p></article></section></article>
<div class="cookie-notice"><p>We use cookies.</p></div><footer>&copy; someone</footer></body></html>"""


def test_html_keeps_the_article_and_nothing_else():
    assert html_extract.main_text(PAGE).split("\n") == ["Big & small", "First bold text of the article.", "Second line goes on", "Quoted words."]


def test_html_without_an_article_uses_density_and_neighbours():
    long = "This is the long paragraph of the page and it has all of the words that a text in a language has to have. " * 3
    page = f"<body><div><a href=1>One</a> <a href=2>Two</a></div><p>{long}</p><p>Short one.</p><p>{long}</p><p><a href=3>More links here</a></p><p>© 2024 all rights reserved</p></body>"
    assert html_extract.main_text(page).split("\n") == [" ".join(long.split()), "Short one.", " ".join(long.split())]


PROSE = "This is the long paragraph of the page and it has all of the words that a text in a language has to have. " * 2
KEPT = {
    "form around the page": f"<body><form><h1>T</h1><p>{PROSE}</p><label>Name</label><input></form></body>",
    "teaser article beside the body": f"<body><article>Short</article><div><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p></div></body>",
    "math": f"<article><p>{PROSE}</p><p>so <math><mi>PROSE</mi></math> holds.</p></article>".replace("PROSE", PROSE),
    "object": f"<article><p>{PROSE}</p><object><p>{PROSE}</p></object></article>",
    **{mark: f"<article><h1>H</h1><p>First words. {PROSE[:80]}</p><div {mark}><p>{PROSE}</p></div></article>" for mark in ('id="discussion"', 'class="article-header"', 'id="related-work"', 'class="notice-period"', 'class="search-algorithms"', 'class="side-effects"')},
}


@pytest.mark.parametrize("case", KEPT)
def test_html_keeps_article_text_whatever_wraps_it(case):
    assert PROSE.strip() in html_extract.main_text(KEPT[case])


def test_html_drops_named_containers_and_calls():
    inner = "".join(f"<div class='{c}'><p>{PROSE}</p></div>" for c in ("cookie-notice", "relatedPosts", "ad", "share-buttons", "comments"))
    page = f"<article><h1>H</h1><div>4 min read</div><p>{PROSE}</p><p>Sign up today</p><p>Ends here.</p>{inner}<div>Tags: a b c</div></article><footer>{PROSE}</footer>"
    assert html_extract.main_text(page).split("\n") == ["H", PROSE.strip(), "Ends here."]


def test_html_takes_time_in_proportion():
    import time

    def seconds(n):
        began = time.process_time()
        html_extract.main_text("<article>" + "<b>x " * n + "<div>" * n + "<p>" + "<i>y" * n)
        return time.process_time() - began

    seconds(500)
    assert seconds(16_000) < 20 * max(seconds(2_000), 0.01)


def walked(page):
    """The independent labeller: the page as a tree, furniture by exact names only, everything else inside the article."""
    from html.parser import HTMLParser

    class Walk(HTMLParser):
        def __init__(self):
            super().__init__()
            self.path, self.text, self.found = [], "", []

        def cut(self):
            words = " ".join(self.text.split())
            if words and "article" in self.path and not any(t in ("nav", "aside", "footer", "script", "style") or t.startswith(".") for t in self.path):
                self.found.append(words)
            self.text = ""

        def handle_starttag(self, tag, attrs):
            if tag not in ("b", "a", "i"):
                self.cut()
            self.path.append("." if dict(attrs).get("class") in ("ad", "cookie-notice", "comments") else tag)

        def handle_endtag(self, tag):
            if tag not in ("b", "a", "i"):
                self.cut()
            self.path.pop()

        def handle_data(self, data):
            self.text += data

    walk = Walk()
    walk.feed(page)
    return "\n".join(walk.found)


def test_html_equals_a_tree_walk_on_generated_pages():
    rng = random.Random(13)
    words = PROSE.split()
    say = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) + "."
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(1, 8)):
            kind = rng.choice(["p", "p", "p", "h2", "blockquote", "aside", "div class='ad'", "div class='cookie-notice'", "section class='comments'", "script"])
            inner = say() if kind == "script" else rng.choice([say(), f"<b>{say()}</b> &amp; {say()}", f"{say()} <i>{say()}</i>"])
            parts.append(f"<{kind}>{inner}</{kind.split()[0]}>" if kind in ("p", "h2", "script") else f"<{kind}><p>{inner}</p></{kind.split()[0]}>")
        page = f"<html><body><nav><p>{say()}</p></nav><div class='ad'><p>{say()}</p></div><article>{''.join(parts)}</article><footer><p>{say()}</p></footer></body></html>"
        assert html_extract.main_text(page) == walked(page), page


@pytest.mark.parametrize("page", [None, "", "<", "<p", "</", "<!--", "<p>a<", "&am", "<script>x", "<div><div><p></div></p></div>", "<p>" * 3000, "<a href='x><p>text", "<p>x &quo"])
def test_html_takes_broken_pages(page):
    assert isinstance(html_extract.main_text(page), str)


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (None, None, None, "x"), (1, "u", PAGE, "x")], "page_id bigint, url string, html string, text string")
    got = html_extract.extract_pages(pages).collect()
    assert sorted(r.n_chars for r in got)[0] == 0 and len(got) == 3 and all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- 9 token counts


def greedy(word, start, inner):
    count, at = 0, 0
    while at < len(word):
        pieces = inner if at else start
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 0
        count, at = count + 1, end
    return count


def test_automaton_counts_like_greedy_longest_match():
    rng = random.Random(6)
    for _ in range(60):
        make = lambda n: {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(n)}  # noqa: E731, B023
        start, inner = make(rng.randint(1, 12)), make(rng.randint(1, 12))
        automaton = token_counts.Automaton(sorted(start), sorted(inner))
        for _ in range(80):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
            assert automaton.count(word) == greedy(word, start, inner), (start, inner, word)


def test_token_counts_over_documents(spark):
    start, inner = map(set, token_counts.load_pieces(VOCABULARY))
    texts = [*ODD[:7], (30, "Reading déjà vu words, 日本 and codes42")]
    got = token_counts.count_tokens(docs(spark, texts), VOCABULARY).collect()
    for r in got:
        text = next(t for i, t in texts if i == r.doc_id)
        counts = [greedy(w, start, inner) for w in (text or "").encode().split()]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(counts), sum(counts) + counts.count(0), counts.count(0))
    assert token_counts.count_tokens(docs(spark, []), VOCABULARY).count() == 0


# ---------------------------------------------------------------- 10 embeddings


def test_embedding_classes_and_links(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BUCKET_ALL", 2)
    monkeypatch.setattr(embed_dedup, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(7)
    base = rng.standard_normal((40, 24))
    rows = [(k, [float(x) for x in base[k % 40] + rng.standard_normal(24) * 0.05 * (k >= 40)]) for k in range(160)]
    rows += [(500 + k, [float(x) for x in base[0] + rng.standard_normal(24) * 0.04]) for k in range(60)]
    bad = [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] * 24), (904, [None, 1.0]), (905, [float("inf")] * 24), (906, [1.0, 2.0]), (None, rows[0][1]), (0, rows[0][1]), (907, [1e300] * 24)]
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows + bad], "vec_id bigint, embedding array<double>, id string, component string").repartition(3)
    got = embed_dedup.dedup_report(frame).collect()
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    links = [(a, b) for a, b in combinations(unit, 2) if unit[a] @ unit[b] >= 0.9]
    classes = components(links, unit)
    degree = {i: sum(i in p for p in links) for i in unit}
    by = {r.vec_id: r for r in got}
    assert len(got) == len(rows + bad)
    assert {i: by[i].component_id for i in unit} == classes and {i: by[i].n_links for i in unit} == degree
    assert all(by[i].n_links == 0 and by[i].component_id == i for i in range(900, 908)) and by[None].component_id is None
    assert embed_dedup.dedup_report(frame.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [64, 2])
def test_embedding_rim_of_a_group_meets_its_members(spark, monkeypatch, bucket):
    """Rim vectors are close to one outer member of a large group only, and far from the one that leads it."""
    monkeypatch.setattr(embed_dedup, "BUCKET_ALL", bucket)
    monkeypatch.setattr(embed_dedup, "BLOCK_ROWS", 16)
    monkeypatch.setattr(embed_dedup, "keys_of", lambda units, bits, tables: np.zeros((len(units), 1), np.int64))
    monkeypatch.setattr(embed_dedup, "table_shape", lambda *_: (6, 1))
    eye = np.eye(40)
    turn = lambda angle, axis: [float(x) for x in np.cos(angle) * eye[0] + np.sin(angle) * eye[axis]]
    rows = [(0, turn(0, 1))] + [(k, turn(0.4, k)) for k in range(1, 31)] + [(100 + k, turn(0.8, k)) for k in range(1, 31)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").coalesce(1)
    by = {r.vec_id: r for r in embed_dedup.dedup_report(frame).collect()}
    unit = {i: np.array(v) for i, v in rows}
    links = [(a, b) for a, b in combinations(unit, 2) if unit[a] @ unit[b] >= 0.9]
    assert {r.component_id for r in by.values()} == {0}
    assert {i: by[i].n_links for i in unit} == {i: sum(i in p for p in links) for i in unit}


def test_embedding_copies_and_one_large_component(spark):
    """A third of all rows are one vector, a third one chain of near copies; scaled copies link and strings are no ids."""
    rng = np.random.default_rng(3)
    hub, chain = rng.standard_normal(16), rng.standard_normal(16)
    rows = [(k, hub.tolist()) for k in range(900)] + [(1000 + k, (chain + rng.standard_normal(16) * 0.05).tolist()) for k in range(900)] + [(2000 + k, rng.standard_normal(16).tolist()) for k in range(900)] + [(3000, (hub * 2).tolist())]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    by = {r.vec_id: r for r in embed_dedup.dedup_report(frame).collect()}
    unit = np.array([v for _, v in rows]) / np.linalg.norm([v for _, v in rows], axis=1, keepdims=True)
    degree = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert [by[i].n_links for i, _ in rows[:1800]] == degree[:1800].tolist() and by[3000].component_id == 0 and by[3000].n_links == 900
    assert {by[k].component_id for k in range(900)} == {0} and {by[1000 + k].component_id for k in range(900)} == {1000}
    with pytest.raises(TypeError):
        embed_dedup.dedup_report(frame.withColumn("vec_id", F.col("vec_id").cast("string")))


def test_table_shape_reaches_its_recall():
    for rows in (10, 1000, 10**6, 10**9):
        bits, tables = embed_dedup.table_shape(rows)
        assert 1 - (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** tables >= embed_dedup.RECALL


# ---------------------------------------------------------------- the pipeline


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    rows, labels = [], []
    item = "the river of the quiet stone and the paper cloud is in the green table for all of the plain words"
    for k in range(700):
        lang = list(LANGS)[k % 3]
        text = [rng.choice((LANGS[lang] + f" u{k % 90} v{rng.randint(0, 400)}").split()) for _ in range(40)]
        if k % 4 == 0:
            text[7] = text[23] = "idiot"
        if k % 25 == 3:
            text[10:10] = item.split()
        rows.append((k, " ".join(text), lang, "s", 1))
        labels.append((k, 1, int(k % 4 == 0)))
    rows += [(1000 + k, rows[k * 2 + 1][1], rows[k * 2 + 1][2], None, None) for k in range(20)] + [(2000, None, "en", None, None), (2001, "123 !!", None, None, None), (None, rows[5][1], None, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    source = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.identify_language(spark, source, str(tmp_path)).collect()
    assert {r.doc_id for r in kept} == {r[0] for r in rows} - {2000, 2001}
    kept = corpus_pipeline.drop_toxic(spark, spark.createDataFrame(kept, source.schema), str(tmp_path)).collect()
    assert not any("idiot" in r.text for r in kept)
    classes = brute_classes([(r.doc_id, r.text) for r in kept])
    left = [r for r in kept if r.doc_id is None or classes[r.doc_id] == r.doc_id]
    left = [r for r in left if item not in r.text]
    assert set(got) == {r.doc_id for r in left}
    for r in left:
        assert got[r.doc_id].n_tokens == len(library(r.text)) and got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_pipeline_decides_by_row_for_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    item = "the river of the quiet stone and the paper cloud is in the green table"
    plain = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(4)]
    rows = [(None, f"{item} and more"), (None, plain[0]), (1, plain[1]), (1, plain[1]), (2, plain[2]), (2, f"so {item}"), (3, plain[1]), (4, plain[3])]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([(None, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    assert got(corpus_pipeline.drop_contaminated(spark, frame, str(tmp_path))) == sorted((r for r in rows if item not in r[1]), key=str)
    assert got(corpus_pipeline.drop_near_duplicates(spark, frame, str(tmp_path))) == sorted((r for k, r in enumerate(rows) if k not in (3, 6)), key=str)


def test_pipeline_stages_take_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name, schema in (("documents", "doc_id bigint, text string, lang string, source string, n_chars bigint"), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert F  # the entry module imports without a running query
