"""Cleaning passes over blocks, in their contractual order.

Every pass is DataFrame in, DataFrame out, on rows (doc_id, ord, kind, role, level, page, bbox, text).
Statistics of a document are windows or joins on ``doc_id``; only the walk that assigns section roles
is a per-document fold in pandas, because each step depends on the one before.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.functions.text import signature, spaced


def in_doc():  # noqa: ANN201
    """The window of a document (made late: a window needs a session)."""
    return Window.partitionBy("doc_id")


def in_order():  # noqa: ANN201
    return in_doc().orderBy("ord")


# Patterns and tables of the cleaning passes.
CONTROL = r"[\x00-\x08\x0b-\x1f\x7f-\u009f]"
MATH_MARKER = r"(?i)(?:i\s*n\s*l\s*i\s*n\s*e|d\s*i\s*s\s*p\s*l\s*a\s*y)\s*-\s*eq\s*-?\s*[A-Za-z]*\d+"
MATH_FONT = {"¼": " = ", "þ": "+", "ð": "(", "Þ": ")", "Ð": "("}
MATH_FONT_EVIDENCE = r"[A-Za-z0-9][þÞ]|ð[A-Za-z0-9]|[A-Za-z0-9]¼[A-Za-z0-9]"
KEEP_HYPHEN = "co cross ex high in low mid near non off on out pseudo quasi self well".split()
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "\u00a0": " ", "’": "'", "‘": "'", "“": '"', "”": '"', "−": "-", "‑": "-", "‐": "-"}
BACK_MATTER = "acknowledgments|acknowledgements|acknowledgment|acknowledgement|conflicts of interest|conflict of interest|competing financial interests|competing interests|declaration of competing interest|declarations of interest|data availability|supporting information|abbreviations|references|keywords|key words|funding|notes|author information|author contributions|associated content"
LINE_SENSITIVE = ["code", "equation", "table"]


def line_blocks(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One paragraph block per line of a text; blank lines are no blocks but keep their number."""
    lines = documents.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("ord", "text"))
    return lines.filter(F.trim(spaced("text")) != "").select(
        "doc_id", "ord", F.lit("paragraph").alias("kind"), F.lit("unknown").alias("role"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>").alias("bbox"), "text"
    )


def strip_control(blocks: DataFrame) -> DataFrame:
    """Control characters become spaces, maths markers one placeholder; adds their counts."""
    controls, markers = F.regexp_count("text", F.lit(CONTROL)), F.regexp_count("text", F.lit(MATH_MARKER))
    fixed = F.regexp_replace(F.regexp_replace("text", CONTROL, " "), MATH_MARKER, "inline-eq")
    tidy = F.trim(F.regexp_replace(fixed, r"[ \t]{2,}", " "))
    return blocks.withColumns({"n_controls": controls, "n_markers": markers}).withColumn("text", F.when(F.col("n_controls") + F.col("n_markers") > 0, tidy).otherwise(F.col("text")))


def broken_math_font(blocks: DataFrame, least: int = 3) -> DataFrame:
    """``blocks`` with ``broken_font``: whether the document shows enough evidence of a mis-mapped font."""
    return blocks.withColumn("broken_font", F.sum(F.regexp_count("text", F.lit(MATH_FONT_EVIDENCE))).over(in_doc()) >= least)


def repair_math_font(blocks: DataFrame) -> DataFrame:
    fixed = F.col("text")
    for wrong, right in MATH_FONT.items():
        fixed = F.replace(fixed, F.lit(wrong), F.lit(right))
    return broken_math_font(blocks).withColumn("text", F.when(F.col("broken_font"), fixed).otherwise(F.col("text")))


def repair_dash_as_e(blocks: DataFrame) -> DataFrame:
    """Only where the font was found broken: ``2.7e4.2 V`` is a range."""
    fixed = F.regexp_replace("text", r"(\d+(?:\.\d+)?)e(\d+(?:\.\d+)?)(?=\s*(?:[A-Za-zµΩÅ%]|$))", "$1 to $2")
    return blocks.withColumn("text", F.when(F.col("broken_font"), fixed).otherwise(F.col("text")))


def line_number_stats(numbers: DataFrame, total: str = "total_lines") -> DataFrame:
    """Per document: the four tests of (doc_id, at, v, total_lines) rows of lone integers, and their verdict."""
    step = F.col("v") - F.lag("v").over(in_doc().orderBy("at"))
    stats = (
        numbers.withColumn("step", step)
        .groupBy("doc_id")
        .agg(F.count("*").alias("n"), F.max(total).alias("lines"), F.count_distinct("v").alias("distinct_n"), (F.max("v") - F.min("v") + 1).alias("span"), F.count_if(F.col("step") > 0).alias("rising"), F.percentile(F.when(F.col("step") > 0, F.col("step")), F.lit(0.5)).alias("median_step"))
    )
    numbered = (F.col("n") >= 20) & (F.col("n") >= 0.10 * F.col("lines")) & (F.col("distinct_n") >= 0.5 * F.col("span")) & (F.col("rising") >= 0.70 * (F.col("n") - 1)) & (F.col("median_step") <= 5)
    return stats.withColumn("numbered", F.coalesce(numbered, F.lit(False)))


def strip_line_numbers(blocks: DataFrame) -> DataFrame:
    """Lone integers go from documents whose integers pass the sequence tests."""
    lines = blocks.select("doc_id", "ord", "kind", F.posexplode(F.split("text", "\n")).alias("line", "value")).withColumn("total_lines", F.count("*").over(in_doc()))
    multi = F.count("*").over(Window.partitionBy("doc_id", "ord")) > 1
    lone = lines.withColumn("multi", multi).filter(F.col("multi") & ~F.col("kind").isin("table", "code", "reference") & F.col("value").rlike(r"^\s*\d{1,4}\s*$"))
    at = F.struct("ord", "line")
    verdict = line_number_stats(lone.select("doc_id", at.alias("at"), F.trim("value").cast("int").alias("v"), "total_lines")).filter("numbered").select("doc_id", F.lit(True).alias("numbered"))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda s: ~s.rlike(r"^\s*\d{1,4}\s*$")), "\n")
    applies = F.coalesce("numbered", F.lit(False)) & F.contains("text", F.lit("\n")) & ~F.col("kind").isin("table", "code", "reference")
    return blocks.join(verdict, "doc_id", "left").withColumn("text", F.when(applies, kept).otherwise(F.col("text"))).drop("numbered")


def split_stacked_headings(blocks: DataFrame) -> DataFrame:
    """A later line of a heading that opens with a multi-level number starts a heading of its own."""
    marked = F.regexp_replace("text", r"\n(?=\s*\d+(?:\.\d+)+\.?\s+\S)", "\x01")
    parts = F.when(F.col("kind") == "heading", F.filter(F.split(marked, "\x01"), lambda p: F.trim(p) != "")).otherwise(F.array("text"))
    whole = F.when(F.size(parts) > 0, parts).otherwise(F.array("text"))
    return renumber(blocks.withColumn("parts", whole).select("*", F.posexplode("parts").alias("part", "part_text")).drop("parts").withColumn("text", F.col("part_text")).drop("part_text"), "part")


def renumber(blocks: DataFrame, *then: str) -> DataFrame:
    """``ord`` counted anew from 0, by the old order and the columns in ``then``, which go."""
    return blocks.withColumn("ord", (F.row_number().over(in_doc().orderBy("ord", *then)) - 1).cast("int")).drop(*then)


def dehyphenated(text: Column) -> Column:
    """One paragraph's text: soft hyphens and ligatures gone, broken words joined or kept, lines flattened."""
    out = F.regexp_replace(text, "\u00ad\\s*", "")
    for wrong, right in LIGATURES.items():
        out = F.replace(out, F.lit(wrong), F.lit(right))
    keep = "|".join(KEEP_HYPHEN)
    # join when: the tail has two letters or more, no inner capital, no short capitalised stem, no kept prefix,
    # the continuation starts in lower case and is not itself hyphenated
    out = F.regexp_replace(out, rf"(?<!\w)(?!(?i:{keep})[-]\n)(?!\p{{Lu}}\w{{0,2}}-\n)(\w[^\W\p{{Lu}}]+)-\n(?![\p{{Lu}}\d])(\w+)(?!\w*-)", "$1$2")
    out = F.regexp_replace(out, r"-\n(?=\w)", "-")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]*\n[ \t]*", " "), r"[ \t]{2,}", " "))


def dehyphenate(blocks: DataFrame) -> DataFrame:
    plain = F.regexp_replace("text", "\u00ad\\s*", "")
    for wrong, right in LIGATURES.items():
        plain = F.replace(plain, F.lit(wrong), F.lit(right))
    return blocks.withColumn("text", F.when(F.col("kind").isin(LINE_SENSITIVE), plain).otherwise(dehyphenated(F.col("text"))))


def page_furniture(blocks: DataFrame, edge: float = 0.12) -> DataFrame:
    """``blocks`` whose repeated running heads, stamps and their variants became page artifacts.

    (a) a signature in an edge band on at least max(2, 30 %) of the pages; (b) one anywhere on at
    least max(3, 90 %); (c) an edge block whose signature contains a repeated one of 24 characters.
    """
    page = Window.partitionBy("doc_id", "page")
    top, bottom = F.min("bbox.y0").over(page), F.max("bbox.y1").over(page)
    height = F.greatest(bottom - top, F.lit(1.0))
    eligible = F.col("page").isNotNull() & F.col("bbox").isNotNull() & (F.trim("text") != "") & ~F.col("kind").isin("figure", "table") & (F.length("text") <= 200)
    rows = blocks.withColumns({"eligible": eligible, "at_edge": F.least((F.col("bbox.y0") - top) / height, (bottom - F.col("bbox.y1")) / height) <= edge, "sig": signature("text")})
    pages = blocks.filter("page IS NOT NULL").groupBy("doc_id").agg(F.count_distinct("page").alias("n_pages")).filter("n_pages >= 2")
    seen = rows.filter("eligible").groupBy("doc_id", "sig").agg(F.count_distinct(F.when(F.col("at_edge"), F.col("page"))).alias("edge_pages"), F.count_distinct("page").alias("any_pages")).join(pages, "doc_id")
    seen = seen.withColumns({"repeats": F.col("edge_pages") >= F.greatest(F.lit(2), F.ceil(0.30 * F.col("n_pages"))), "stamp": F.col("any_pages") >= F.greatest(F.lit(3), F.ceil(0.9 * F.col("n_pages")))})
    long = seen.filter("repeats AND length(sig) >= 24").groupBy("doc_id").agg(F.collect_set("sig").alias("long_sigs"))
    judged = rows.join(seen.select("doc_id", "sig", "repeats", "stamp"), ["doc_id", "sig"], "left").join(long, "doc_id", "left")
    holds = F.exists(F.coalesce("long_sigs", F.array().cast("array<string>")), lambda s: F.contains(F.col("sig"), s))
    furniture = F.col("eligible") & ((F.col("at_edge") & (F.coalesce("repeats", F.lit(False)) | holds)) | F.coalesce("stamp", F.lit(False)))
    return judged.withColumn("kind", F.when(furniture, F.lit("page_artifact")).otherwise(F.col("kind"))).select(*blocks.columns)


def drop_empty(blocks: DataFrame) -> DataFrame:
    return blocks.filter((F.trim(spaced("text")) != "") | F.col("kind").isin("figure", "table"))


def continues(left_kind: Column, left: Column, kind: Column, right: Column) -> Column:
    """Does a paragraph go on in the next one?"""
    left, right = F.rtrim(left), F.ltrim(right)
    opens = left.rlike(r"[-,(\[]\s*$") | left.rlike(r"(?i)\b(?:e\.g|i\.e|cf|vs|et al|Fig|Eq|Ref|approx|ca)\.\s*$")
    ends = left.rlike(r"[.!?:;]['\")\]]?\s*$")
    return (left_kind == "paragraph") & (kind == "paragraph") & (left != "") & (right != "") & (opens | (~ends & right.rlike(r"^[a-z(\[]")))


def merge_continuations(blocks: DataFrame) -> DataFrame:
    """Paragraph fragments rejoined across page furniture; adds ``merged_from`` and ``spans_pages``."""
    transparent = (F.col("kind") == "page_artifact") | ((F.col("kind") == "figure") & (F.trim(F.coalesce("text", F.lit(""))) == ""))
    solid = F.when(~transparent, F.struct("kind", "text"))
    before = F.last(solid, ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    joins = F.coalesce(~transparent & continues(before["kind"], before["text"], F.col("kind"), F.col("text")), F.lit(False))
    rows = blocks.withColumn("transparent", transparent).withColumn("joins", joins)
    island = F.sum(F.when(F.col("joins") | F.col("transparent"), 0).otherwise(1)).over(in_order())
    rows = rows.withColumn("island", F.when(F.col("transparent"), -F.col("ord") - 1).otherwise(island))
    piece = F.struct("ord", "text", "page")
    first = F.min_by(F.struct(*(c for c in blocks.columns if c not in ("doc_id", "text"))), "ord")
    merged = rows.groupBy("doc_id", "island").agg(first.alias("first"), F.array_sort(F.collect_list(piece)).alias("pieces"))
    text = F.aggregate("pieces", F.lit(""), lambda acc, p: F.when(acc == "", p["text"]).otherwise(F.concat(F.rtrim(acc), F.when(F.rtrim(acc).endswith("-"), F.lit("")).otherwise(F.lit(" ")), F.ltrim(p["text"]))))
    pages = F.array_distinct(F.filter(F.transform("pieces", lambda p: p["page"]), lambda p: p.isNotNull()))
    out = merged.select("doc_id", "first.*", text.alias("text"), F.size("pieces").alias("merged_from"), (F.size(pages) > 1).alias("spans_pages"))
    return renumber(out.select(*blocks.columns, "merged_from", "spans_pages"))


def boundary(text: Column) -> Column:
    """1-based position where back matter or a rights notice starts inside a paragraph, or null."""
    rights = r"(?<=[.!?])\s+(?=©|\(c\)\s|Copyright\b|All rights reserved\b|This (?:is|article is) an open[- ]access\b|Published by .{0,40}\bunder (?:a |the )?Creative Commons\b)"
    heading = rf"(?:(?<=[.!?])\s+|\s*(?=[■▪●◆•]))[■▪●◆•]?\s*(?=\p{{Lu}})(?i:{BACK_MATTER})\b(?=\s*(?::|$|[■▪●◆•*⊥†‡]|[A-Z(]))"
    at = lambda pattern: F.regexp_instr(text, F.lit(pattern))
    later = F.regexp_instr(F.substring(text, 41, 1 << 30), F.lit(r"(?s)" + rights))
    cut_rights = F.when(later > 0, later + 40)
    first_heading = at(heading)
    cut_heading = F.when(first_heading > 40, first_heading)
    early = (first_heading > 0) & (first_heading <= 40)
    return F.when(early, F.lit(None).cast("int")).otherwise(F.least(cut_rights, cut_heading))


def split_back_matter(blocks: DataFrame) -> DataFrame:
    cut = F.when(F.col("kind") == "paragraph", boundary(F.col("text")))
    parts = F.when(F.col("cut").isNull(), F.array("text")).otherwise(F.array(F.rtrim(F.expr("substring(text, 1, cut - 1)")), F.trim(F.expr("substring(text, cut)"))))
    rows = blocks.withColumn("cut", cut).select("*", F.posexplode(parts).alias("part", "part_text"))
    return renumber(rows.withColumn("text", F.col("part_text")).drop("cut", "part_text"), "part")


# Heading patterns in order; the first that matches gives the role.
ROLE_PATTERNS = [
    ("abstract", r"abstract\b"),
    ("keywords", r"key\s*words?\b"),
    ("references", r"(references|bibliography|literature cited)\b"),
    ("acknowledgement", r"acknowledge?ment"),
    ("funding", r"(funding|financial support|grant information)\b"),
    ("ethics", r"(ethic|conflicts? of interest|competing interests?|declaration|author contributions?|data availability|credit authorship|supporting information)"),
    ("appendix", r"(appendix|supplementary)\b"),
    ("introduction", r"(introduction|background)\b"),
    ("methods", r"(methods?|materials and methods|experimental(\s+(section|details?|methods?))?|methodology|model(ling|ing)? (setup|details)|computational details)\b"),
    ("results", r"(results?)(\s+and\s+discussion)?\b"),
    ("discussion", r"discussion\b"),
    ("conclusion", r"(conclusions?|concluding remarks|outlook|summary and (outlook|future|perspectives?|conclusions?)|summary)\b"),
]
BOILERPLATE_HINT = r"(?is)\bdownloaded from\b|\barticle starts on next page\b|\bcitation for the (original|published)\b|\bwhen citing this work\b|\boffers the possibility of retrieving\b|\bthis is the (accepted|author)|\ball rights reserved\b|\bopen access\b.{0,60}\bcreative commons\b|^\s*received:.{0,80}\baccepted:|\bpublished online:\s*\d|\bterms of use\b|\bsupplementary (material|information) (is )?available\b"
AFFILIATION_HINT = r"(?i)\b(university|universitet|institute|institutt|department|laborator|college|school of|centre|center|academy|hospital|gmbh|ltd|(?-i:A/?S)|dept|inc|norway|sweden|denmark)\b"
REFERENCE_ENTRY = (r"^\s*(\[\d+\]|\(\d+\)|\d{1,3}\.\s)", r"(?i)\b(19|20)\d{2}\b|\bdoi\b|\barxiv\b|\bpp?\.\s*\d|\bvol\.|\bno\.\s*\d|\bed(s)?\.")


def role_for_heading(text: str | Column = "text") -> Column:
    """The role that a heading's words name, or null."""
    t = F.regexp_replace(F.trim(F.col(text) if isinstance(text, str) else text), r"^\s*(?:\d+(?:\.\d+)*|[IVXLC]+)[.)]?\s+", "")
    out = None
    for role, pattern in ROLE_PATTERNS:
        out = F.when(t.rlike(rf"(?i)^\s*{pattern}"), F.lit(role)) if out is None else out.when(t.rlike(rf"(?i)^\s*{pattern}"), F.lit(role))
    return out


def is_reference_entry(text: str = "text") -> Column:
    return F.col(text).rlike(REFERENCE_ENTRY[0]) & F.col(text).rlike(REFERENCE_ENTRY[1])


def front_matter(blocks: DataFrame, window: int = 40) -> DataFrame:
    """``blocks`` with roles of the front matter: title, abstract, keywords, affiliation, authors, boilerplate.

    The front matter ends at the first structural heading, at the end of the first page, or after
    ``window`` blocks.
    """
    structural = (F.col("kind") == "heading") & (role_for_heading().isNotNull() | F.col("text").rlike(r"^\s*\d+(?:\.\d+)*[.)]?\s+\S"))
    first_page = F.first("page", ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    end = F.min(F.when(structural | (F.col("page") != first_page) | (F.col("ord") >= window), F.col("ord"))).over(in_doc())
    rows = blocks.withColumn("front", F.col("ord") < F.coalesce(end, F.lit(window)))
    candidate = F.col("front") & (F.trim("text") != "") & (F.col("kind") != "page_artifact")
    size = F.coalesce("font_max", F.lit(0.0)) if "font_max" in blocks.columns else F.lit(0.0)
    rank = F.when(candidate, F.sum(candidate.cast("int")).over(in_order()))
    rows = rows.withColumn("place", rank).withColumn("title_ord", F.max_by(F.when(F.col("place") <= 5, F.col("ord")), F.when(F.col("place") <= 5, F.struct(size, -F.col("ord")))).over(in_doc()))
    after = candidate & (F.col("ord") > F.col("title_ord"))
    label = (
        F.when(F.col("text").rlike(BOILERPLATE_HINT), F.lit("boilerplate"))
        .when(F.col("text").rlike(r"(?i)^\s*key\s*words?\b"), F.lit("keywords"))
        .when(F.col("text").rlike(r"(?i)^\s*(abstract|summary)\b"), F.lit("abstract"))
    )
    rows = rows.withColumn("label", F.when(after, label))
    sticky = F.last("label", ignorenulls=True).over(in_order())
    separators, capitals = F.regexp_count("text", F.lit("[,;·•]")), F.regexp_count("text", F.lit(r"(?<!\S)\p{Lu}"))
    authors = (F.length("text") <= 400) & ~F.trim("text").endswith(".") & (separators >= 1) & (capitals >= 2) & (F.size(F.split(F.trim("text"), r"\s+")) <= 60)
    guess = F.when(sticky == "abstract", F.lit("abstract")).when(F.col("text").rlike(r"[\w.+-]+@[\w-]+\.[\w.]+") | F.col("text").rlike(AFFILIATION_HINT), F.lit("affiliation")).when(authors, F.lit("authors"))
    role = F.when(candidate & (F.col("ord") == F.col("title_ord")), F.lit("title")).when(after, F.coalesce("label", guess, "role")).otherwise(F.col("role"))
    text = F.when((role == "abstract") & F.col("text").rlike(r"(?i)^\s*(abstract|summary)\s*[:.—-]?\s+\S"), F.regexp_replace("text", r"^\s*(?i:abstract|summary)\s*[:.—-]?\s+(?=[A-Z(])", "")).when(role == "title", F.regexp_replace("text", r"^(?:[^a-z\s]*[A-Z][^a-z\s]*\s+){4,}(?=[A-Z][a-z].{18,})", "")).otherwise(F.col("text"))
    kind = F.when((role == "title") & (F.col("kind") == "paragraph"), F.lit("heading")).when((role == "authors") & (F.col("kind") == "heading"), F.lit("paragraph")).otherwise(F.col("kind"))
    return rows.withColumns({"role": role, "text": text, "kind": kind}).select(*blocks.columns, "front")


def assign_sections(blocks: DataFrame) -> DataFrame:
    """Front matter, then for every other block its heading (``section``), parent and role."""
    rows = front_matter(blocks).withColumn("named", F.when(F.col("kind") == "heading", role_for_heading()))
    body = ~F.col("front")
    section = F.last(F.when(body & (F.col("kind") == "heading"), F.col("ord")), ignorenulls=True).over(in_order())
    rows = rows.withColumn("section", section)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", parent int"

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord", kind="stable").reset_index(drop=True)
        stack: list[tuple[int, int]] = []
        role, seen, back = "unknown", False, False
        roles, parents, kinds = list(group["role"]), [None] * len(group), list(group["kind"])
        for k, row in enumerate(group.itertuples()):
            if row.front:
                continue
            if row.kind == "heading":
                level = 1 if pd.isna(row.level) else int(row.level)
                while stack and stack[-1][0] >= level:
                    stack.pop()
                parents[k] = stack[-1][1] if stack else None
                if row.named is not None and not pd.isna(row.named):
                    role, back = row.named, row.named in ("references", "acknowledgement", "funding", "ethics")
                elif not seen:
                    role = "body"
                elif back:
                    role, back = ("body", False) if level == 1 else (role, True)
                elif role == "unknown":
                    role = "body"
                roles[k], seen = role, True
                stack.append((level, int(row.ord)))
                continue
            parents[k] = stack[-1][1] if stack else None
            roles[k] = role if seen else "unknown"
            if role == "references" and row.kind == "paragraph":
                kinds[k] = "reference"
        if "references" not in roles:
            start = _reference_start([(t, kd) for t, kd, r in zip(group["text"], kinds, roles, strict=True)])
            if start is not None:
                for k in range(start, len(group)):
                    if str(group["text"][k]).strip():
                        roles[k], kinds[k] = "references", "reference" if kinds[k] == "paragraph" else kinds[k]
        return group.assign(role=roles, kind=kinds, parent=pd.array(parents, dtype="Int32"))

    return rows.groupBy("doc_id").applyInPandas(walk, schema).drop("front", "named")


def _reference_start(blocks: list[tuple[str, str]], scan: int = 200, least: int = 5, gap_most: int = 3) -> int | None:
    """Where an unheaded reference list begins: walk back from the end until entries stop coming."""
    import re

    marker, signal = (re.compile(p) for p in REFERENCE_ENTRY)
    entries, gap, start = 0, 0, None
    window = [k for k, (_, kind) in enumerate(blocks) if kind != "heading"][-scan:]
    for k in reversed(window):
        text, kind = blocks[k]
        if re.match(r"(?i)^\s*(references|bibliography|literature cited)\s*:?\s*$", text):
            return k
        if marker.match(text) and signal.search(text):
            start, entries, gap = k, entries + 1, 0
        elif kind != "page_artifact" and text.strip():
            gap += 1
            if gap > gap_most:
                break
    return start if entries >= least else None


# Caption labels, credits and panel marks.
CAPTION_LABEL = r"(?i)^\s*(fig(?:ure)?|table|scheme|chart|plate)\s*\.?\s*(\d+|[IVXLC]+)(?:\s*[.:)]|\s+[-–—]\s+)\s*"
CREDIT = r"(?is)\s*(?:reproduced|adapted|reprinted)\s+(?:with\s+permission\s+)?from\b.*$|\s*copyright\s*(?:©|\(c\))?\s*\d{4}.*$|\s*©\s*\d{4}.*$"
PANEL = r"\s*[(\[]\s*[a-h]\s*(?:[-–—,]\s*[a-h]\s*)?[)\]]|\s+[a-h]\)\s"
TITLE_CHARS, FRAGMENT_GAP = 125, 60.0


def caption_subject(text: Column) -> Column:
    """The title-like statement of a caption: no label, credit or panels, one sentence, 125 characters."""
    body = F.regexp_replace(F.regexp_replace(F.trim(text), CAPTION_LABEL, ""), CREDIT, "")
    parts = F.filter(F.transform(F.split(body, PANEL), lambda p: F.trim(p)), lambda p: p != "")
    body = F.coalesce(F.get(parts, F.lit(0)), body)
    first = F.get(F.split(body, r"(?<=[.!?])\s+(?=[A-Z(\[])"), F.lit(0))
    first = F.rtrim(F.regexp_replace(F.regexp_replace(first, r"\s+", " "), r"[ .;,:]+$", ""))
    cut = F.regexp_replace(F.regexp_replace(F.substring(first, 1, TITLE_CHARS), r"\s+\S*$", ""), r"[ .;,:]+$", "")
    return F.when(F.length(first) > TITLE_CHARS, cut).otherwise(first)


def captions(blocks: DataFrame) -> DataFrame:
    """(doc_id, ord, label, number, subject, references): captions and the prose blocks that cite their number."""
    label = F.lower(F.regexp_extract("text", CAPTION_LABEL, 1))
    own = blocks.filter("kind = 'caption'").select("doc_id", "ord", F.when(label == "table", F.lit("table")).otherwise(F.lit("figure")).alias("label"), F.when(label == "", F.lit("figure")).otherwise(label).alias("word"), F.regexp_extract("text", CAPTION_LABEL, 2).alias("number"), caption_subject(F.col("text")).alias("subject"))
    mention = r"(?i)\b(fig(?:ure)?|table|scheme|chart|plate)s?\.?\s*(\d+|[IVXLC]+)\b"
    prose = blocks.filter(F.col("kind").isin("paragraph", "list_item")).select("doc_id", F.col("ord").alias("cited"), F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(mention), 1).alias("w"), F.regexp_extract_all("text", F.lit(mention), 2).alias("n"))).alias("m"))
    cites = prose.select("doc_id", "cited", F.lower("m.w").alias("word"), F.col("m.n").alias("number")).distinct()
    found = own.join(cites, ["doc_id", "word", "number"], "left")
    return found.groupBy("doc_id", "ord", "label", "number", "subject").agg(F.array_sort(F.collect_set("cited")).alias("references"))


def figure_members(blocks: DataFrame) -> DataFrame:
    """(doc_id, caption, member): artwork that a caption speaks for, first claim wins.

    A band join on the page finds the fragments above (else below) a caption, and the run of
    fragments ends at the first gap above FRAGMENT_GAP; without boxes the neighbour in order counts.
    """
    caps = blocks.filter("kind = 'caption'").select("doc_id", F.col("ord").alias("caption"), "page", F.col("bbox").alias("cap"), F.when(F.col("text").rlike(r"(?i)^\s*table"), F.lit("table")).otherwise(F.lit("figure")).alias("wants"))
    art = blocks.filter(F.col("kind").isin("figure", "table")).select("doc_id", F.col("ord").alias("member"), "page", F.col("bbox").alias("box"), F.col("kind").alias("wants"))
    near = caps.filter("cap IS NOT NULL AND page IS NOT NULL").join(art.filter("box IS NOT NULL"), ["doc_id", "page", "wants"])
    above = near.filter("box.y1 <= cap.y0 + 2").selectExpr("doc_id", "caption", "member", "0 AS side", "cap.y0 - box.y1 AS distance", "cap.y0 - box.y0 AS reach")
    below = near.filter("box.y0 >= cap.y1 - 2").selectExpr("doc_id", "caption", "member", "1 AS side", "box.y0 - cap.y1 AS distance", "box.y1 - cap.y1 AS reach")
    sides = above.unionByName(below)
    walk = Window.partitionBy("doc_id", "caption", "side").orderBy("distance", "member")
    gap = F.col("distance") - F.lag("reach").over(walk)
    run = sides.withColumn("broken", (gap > FRAGMENT_GAP).cast("int")).withColumn("breaks", F.sum(F.coalesce("broken", F.lit(0))).over(walk)).filter("breaks = 0")
    chosen = run.withColumn("best", F.min("side").over(Window.partitionBy("doc_id", "caption"))).filter("side = best").select("doc_id", "caption", "member")
    loose = caps.join(chosen.select("doc_id", "caption").distinct(), ["doc_id", "caption"], "left_anti").join(art.drop("page"), ["doc_id", "wants"]).filter("abs(member - caption) = 1 AND (cap IS NULL OR box IS NULL)").groupBy("doc_id", "caption").agg(F.min("member").alias("member"))
    first = Window.partitionBy("doc_id", "member").orderBy("caption")
    return chosen.unionByName(loose).withColumn("claim", F.row_number().over(first)).filter("claim = 1").drop("claim")


def link_figures(blocks: DataFrame) -> DataFrame:
    """Captions with their members, joint region, content and references; orphan artwork has no row."""
    members = figure_members(blocks).join(blocks.select("doc_id", F.col("ord").alias("member"), "bbox", F.col("text").alias("member_text")), ["doc_id", "member"])
    joint = members.groupBy("doc_id", F.col("caption").alias("ord")).agg(
        F.array_sort(F.collect_list("member")).alias("members"),
        F.struct(F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1")).alias("region"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("member", F.trim(F.coalesce("member_text", F.lit(""))).alias("t")))), lambda m: F.nullif(m["t"], F.lit(""))), "\n\n").alias("content"),
    )
    return captions(blocks).join(joint, ["doc_id", "ord"], "left")


def place_figures(blocks: DataFrame) -> DataFrame:
    """Captions moved forward to just after the first block of their section that cites them (``place``)."""
    first = captions(blocks).select("doc_id", "ord", F.array_min("references").alias("cited")).filter("cited IS NOT NULL")
    rows = blocks.join(first, ["doc_id", "ord"], "left")
    return rows.withColumn("place", F.when(F.col("cited") > F.col("ord"), F.col("cited") + 0.5).otherwise(F.col("ord").cast("double"))).drop("cited")


def sentence_spans(text: Column | str) -> Column:
    """Offsets of the sentences, with the abbreviation guards."""

    @F.pandas_udf("array<struct<char_start:int,char_end:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"char_start": a, "char_end": b} for a, b in spans_of(t or "")])

    return cut(text)


def spans_of(text: str) -> list[tuple[int, int]]:
    import re

    from studyloom.functions.text import ABBREVIATIONS

    guard = re.compile(r"(?:(?i:\b(?:" + "|".join(map(re.escape, ABBREVIATIONS)) + r"))\.|\b[A-Z]\.|\d\.)\s*$")
    cuts = [m for m in re.finditer(r"(?<=[.!?])[\"')\]]*\s+", text)]
    out, start = [], 0

    def add(a: int, b: int) -> None:
        piece = text[a:b]
        if piece.strip():
            out.append((a + len(piece) - len(piece.lstrip()), b - len(piece) + len(piece.rstrip())))

    for m in cuts:
        if not guard.search(text[max(start, m.start() - 12) : m.start()]):
            add(start, m.start())
            start = m.end()
    add(start, len(text))
    return out


def split_sentences(blocks: DataFrame, *also: str, only: Column | None = None) -> DataFrame:
    """(doc_id, ord, sent_ix, char_start, char_end, text, kind, role) of prose blocks, and the columns ``also`` of their block.

    With ``only`` no block is left out: those that it does not hold for, or without a sentence, are a row without one.
    """
    cut = ~F.col("kind").isin("code", "equation", "page_artifact") & (F.trim("text") != "")
    prose = blocks.filter(cut).withColumn("spans", sentence_spans("text")) if only is None else blocks.withColumn("spans", sentence_spans(F.when(cut & only, F.col("text"))))
    explode = F.posexplode if only is None else F.posexplode_outer
    spans = prose.select("doc_id", "ord", "kind", "role", *also, F.col("text").alias("block_text"), explode("spans").alias("sent_ix", "span"))
    return spans.select("doc_id", "ord", "sent_ix", "span.char_start", "span.char_end", F.expr("substring(block_text, span.char_start + 1, span.char_end - span.char_start)").alias("text"), "kind", "role", *also)


def clean(blocks: DataFrame) -> DataFrame:
    """All passes in order; adds section, parent and merge columns."""
    out = strip_control(blocks).drop("n_controls", "n_markers")
    out = dehyphenate(split_stacked_headings(strip_line_numbers(repair_math_font(out))))
    out = merge_continuations(drop_empty(page_furniture(out)))
    return assign_sections(split_back_matter(repair_dash_as_e(out)))

