"""The adapter registry, the Markdown/text scanner and the HTML block extractor.

An adapter turns a file into block rows (doc_id, ord, kind, role, level, page, bbox, text).  The two
scanners are per-document state machines, so they run as Arrow-batched ``mapInPandas``; the corpus
stays distributed by file.  PDF needs a renderer that this environment lacks: its geometry rules are
DataFrame functions in ``sources.layout`` and work on raw blocks from any extractor.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.schema import BLOCKS


class IngestError(ValueError):
    """A source that cannot be read."""


Adapter = Callable[[DataFrame], DataFrame]
_adapters: dict[str, Adapter] = {}


def register(*extensions: str) -> Callable[[Adapter], Adapter]:
    """Register a function from (doc_id, text) rows to block rows for these file extensions."""

    def add(adapter: Adapter) -> Adapter:
        for extension in extensions:
            _adapters[extension.lower()] = adapter
        return adapter

    return add


def available_extensions() -> list[str]:
    return sorted(_adapters)


def adapter_for(path: str) -> Adapter:
    extension = os.path.splitext(path)[1].lower()
    if extension not in _adapters:
        raise IngestError(f"no adapter for {extension or 'a file without extension'}; known: {', '.join(available_extensions())}")
    return _adapters[extension]


def load(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of every file under ``path`` (a glob or a folder of one kind); doc_id is a hash of the path."""
    files = spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("doc_id"), F.col("value").alias("text"))
    return adapter_for(path)(files)


# Line shapes of the Markdown scanner.
ATX = re.compile(r"^(#{1,6})\s+(\S.*?)\s*#*\s*$")
LIST = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+\S")
FENCE = re.compile(r"^\s*(```|~~~)")
MATH_FENCE, MATH_LINE = re.compile(r"^\s*\$\$\s*$"), re.compile(r"^\s*\$\$(.+?)\$\$\s*$")
TABLE_ROW, TABLE_RULE = re.compile(r"^\s*\|.*\|\s*$"), re.compile(r"^\s*\|(?:\s*:?-{2,}:?\s*\|)+\s*$")
IMAGE = re.compile(r"^\s*!\[([^\]]*)\]\([^)]*\)\s*$")
CAPTION = re.compile(r"^\s*\**(?:figure|fig\.|table|scheme)\s*\d+", re.I)


def scan_markdown(raw: str) -> list[tuple[str, str, int | None]]:
    """(kind, text, level) of every block of a Markdown or plain text."""
    lines = raw.replace("\r\n", "\n").split("\n")
    out: list[tuple[str, str, int | None]] = []
    held: list[str] = []
    state = "paragraph"

    def close(kind: str | None = None, level: int | None = None) -> None:
        nonlocal state
        text = "\n".join(held).strip()
        held.clear()
        if text:
            out.append((kind or state, text, level))
        state = "paragraph"

    def single(kind: str, text: str, level: int | None = None) -> None:
        close()
        if text.strip():
            out.append((kind, text.strip(), level))

    k, fence = 0, ""
    while k < len(lines):
        line, following = lines[k], lines[k + 1] if k + 1 < len(lines) else ""
        k += 1
        if state == "code":
            held.append(line)
            if line.strip().startswith(fence):
                close()
        elif state == "equation":
            if MATH_FENCE.match(line):
                close()
            else:
                held.append(line)
        elif m := FENCE.match(line):
            close()
            state, fence = "code", m.group(1)
            held.append(line)
        elif m := MATH_LINE.match(line):
            single("equation", m.group(1))
        elif MATH_FENCE.match(line):
            close()
            state = "equation"
        elif m := IMAGE.match(line):
            single("figure", m.group(1) or "figure")
        elif TABLE_ROW.match(line) and (state == "table" or TABLE_RULE.match(following)):
            if state != "table":
                close()
                state = "table"
            held.append(line)
        else:
            if state == "table":
                close()
            if not line.strip():
                close()
            elif m := ATX.match(line):
                single("heading", m.group(2), len(m.group(1)))
            elif not held and not CAPTION.match(line) and re.match(r"^(=+|-{2,})\s*$", following):
                single("heading", line, 1 if following[0] == "=" else 2)
                k += 1
            elif LIST.match(line) and not (not held and CAPTION.match(line)):
                single("list_item", line)
            else:
                if not held and CAPTION.match(line):
                    state = "caption"
                held.append(line)
    close()
    return out


def _scan(rows: DataFrame, scanner: Callable[[str], list[tuple[str, str, int | None]]], text_col: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(doc, k, kind, "unknown", level, None, None, text) for doc, raw in zip(batch["doc_id"], batch["text"], strict=True) for k, (kind, text, level) in enumerate(scanner(raw or ""))]
            frame = pd.DataFrame(found, columns=["doc_id", "ord", "kind", "role", "level", "page", "bbox", "text"])
            yield frame.astype({"level": "Int32", "page": "Int32"})

    return rows.select("doc_id", F.col(text_col).alias("text")).mapInPandas(run, BLOCKS)


@register(".md", ".markdown", ".txt")
def markdown_blocks(rows: DataFrame, text_col: str = "text") -> DataFrame:
    return _scan(rows, scan_markdown, text_col)


# Tags that make blocks, and their kinds.
TAG_KINDS = {"p": "paragraph", "li": "list_item", "blockquote": "paragraph", "pre": "code", "figcaption": "caption", "caption": "caption", "table": "table"} | {f"h{k}": "heading" for k in range(1, 7)}
HOLDERS = ("li", "blockquote", "table")


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str, int | None]] = []
        self.open: list[tuple[str, list[str]]] = []
        self.quiet = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "head", "nav", "footer"):
            self.quiet += 1
        elif tag in TAG_KINDS and not (tag == "p" and any(t in HOLDERS for t, _ in self.open)):
            if tag == "p" and self.open and self.open[-1][0] == "p":
                self._close()
            self.open.append((tag, []))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "head", "nav", "footer"):
            self.quiet = max(0, self.quiet - 1)
        elif any(t == tag for t, _ in self.open):
            while self.open:
                if self._close() == tag:
                    break

    def handle_data(self, data: str) -> None:
        if self.open and not self.quiet:
            self.open[-1][1].append(data)

    def _close(self) -> str:
        tag, parts = self.open.pop()
        text = " ".join("".join(parts).split())
        if text:
            self.out.append((TAG_KINDS[tag], text, int(tag[1]) if tag[0] == "h" else None))
        return tag

    def close(self) -> None:
        super().close()
        while self.open:
            self._close()


def scan_html(raw: str) -> list[tuple[str, str, int | None]]:
    """Blocks of the book-like tags of a page or an EPUB chapter; a paragraph inside a list, quote or table is part of it."""
    parser = _Blocks()
    parser.feed(raw)
    parser.close()
    return parser.out


@register(".html", ".xhtml", ".htm")
def html_blocks(rows: DataFrame, text_col: str = "text") -> DataFrame:
    return _scan(rows, scan_html, text_col)


def load_epub(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of EPUB books: the chapters in the archive's order, scanned as HTML."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for batch in batches:
            rows = []
            for doc, content in zip(batch["doc_id"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    chapters = [n for n in book.namelist() if n.lower().endswith((".xhtml", ".html", ".htm"))]
                    blocks = [b for n in chapters for b in scan_html(book.read(n).decode("utf-8", "replace"))]
                rows += [(doc, k, kind, "unknown", level, None, None, text) for k, (kind, text, level) in enumerate(blocks)]
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "kind", "role", "level", "page", "bbox", "text"]).astype({"level": "Int32", "page": "Int32"})

    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("doc_id"), "content")
    return files.mapInPandas(run, BLOCKS)


def titles(blocks: DataFrame) -> DataFrame:
    """(doc_id, title): the first heading of level 1 or 2, else the first block's first 120 characters."""
    heading = F.when((F.col("kind") == "heading") & (F.coalesce("level", F.lit(9)) <= 2), F.col("ord"))
    return blocks.groupBy("doc_id").agg(F.coalesce(F.min_by("text", heading), F.min_by(F.substring("text", 1, 120), "ord")).alias("title"))


def resolve_source(path: str | None = None, url: str | None = None, text: str | None = None) -> tuple[str, str]:
    """Exactly one of the three; pasted text needs 400 characters; only http(s) addresses."""
    given = [(k, v) for k, v in (("path", path), ("url", url), ("text", text)) if v]
    if len(given) != 1:
        raise IngestError("give exactly one of path, url and text")
    kind, value = given[0]
    if kind == "text" and len(value) < 400:
        raise IngestError("a pasted text needs at least 400 characters")
    if kind == "url" and not re.match(r"^https?://", value):
        raise IngestError("only http and https addresses can be fetched")
    return kind, value
