"""HTML extraction: two-pass block rules over a forgiving tag scanner.

The scanner walks the page once, keeps a stack of open elements and cuts text into blocks at
block-level tags.  Scripts, styles, templates and form fields hold no text.  Menus, footers, sidebars,
dialogs, forms, notices, adverts and reader comments are containers, known by tag, ARIA role or a name in
their class or id; a compound name counts only if all of its words do (``cookie-notice`` does,
``related-work`` does not).  Blocks inside a container are bad, with two exceptions that the text
decides: a form, or a named container with an article or a first-level heading, that holds at least half
of the page's prose is a wrapper, and the blocks of a container whose name says little
(``discussion``) are judged like blocks outside an article.

Pass 1 looks at one block alone: link density, length and stop-word density make it good, bad or
undecided.  Pass 2 gives undecided blocks the label of the nearest decided neighbours, furniture
included.  ``article`` and ``main`` elements that hold at least half of the page's prose are evidence: blocks
outside them are bad, inside them a block is bad only when it is nearly all links or a bare call to act,
and a paragraph, heading, list item or quotation takes a bad label only from two bad neighbours inside.

Defined cases: null and empty html give an empty text; a tag or comment cut off by the page's end is
dropped; an unfinished character reference stays as written; where a good and a bad neighbour are
equally near, headings, paragraphs and sentences are good and other blocks bad; pages of any length take
time in proportion to it; repeated rows and null ids give one row each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.common import small_batches

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|template|textarea|title|iframe|select)\b[^>]*+(?:/>|>.*?(?:</(?P=raw)\s*+>|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|</?(?P<odd>[a-zA-Z][a-zA-Z0-9:-]*+)[^>]*+(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|(?P<text>[^<]++|<)",
    re.S | re.I,
)
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD_OF_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Element names and the names that mark page furniture.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SAYING_TAGS = HEADINGS | frozenset("p li blockquote pre dd dt td th figcaption caption summary".split())
ITEM_TAGS = frozenset("li td th tr dd dt option".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HOLD_TAGS = frozenset("aside nav footer dialog menu".split())
FIELD_TAGS = frozenset("button label legend".split())
HOLD_ROLES = frozenset("navigation banner contentinfo complementary dialog alert alertdialog menu menubar toolbar".split())
COMMENT_NAMES = frozenset("comment comments reply replies respond disqus".split())
OTHERS_NAMES = frozenset("related recommended recommendations teaser teasers".split())
SKIP_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored sponsors promo promoted banner banners"
    " cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription paywall"
    " nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc"
    " header masthead topbar footer bottombar copyright sidebar sidebars widget widgets"
    " share sharing social login signup signin".split()
)
WEAK_NAMES = frozenset("discussion discussions side search register promotion rail foot skip".split())
#: Words that say nothing by themselves: with a word above they make a name of furniture.
PLAIN_WORDS = frozenset("area bar block box btn button buttons col column container content div form group inner item items left link links list main outer panel post posts articles right row section site slot stories top bottom unit wrap wrapper zone page global the".split())

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an the and or but if of to in on at by for from with as is are was were be been it its this that these those he she they we you i his her their our your not no so than then there here which who what when where how will would can could has have had do does did"
    " der die das den dem des ein eine einer eines einem einen und oder aber wenn von zu im in am an auf bei mit aus nach ist sind war waren sein es sie er wir ihr ich nicht kein so als auch noch nur wie was wer wo wird werden hat haben hatte für über unter durch zum zur"
    " le la les un une des du de et ou mais si à au aux en dans sur par pour avec sans est sont était être il elle ils elles nous vous je on ce cette ces qui que quoi dont où ne pas plus se sa son ses leur leurs"
    " el la los las un una unos unas y o pero si de del a al en con por para sin es son era ser está hay él ella ellos nosotros yo no más que quien cual donde como se su sus lo le les este esta".split()
)

LINKS_MAX, LINKS_MAX_ARTICLE = 0.5, 0.8
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOPS_LOW, STOPS_HIGH = 0.15, 0.25
#: Share of the page's prose that makes an article the body and a form a wrapper.
BODY_SHARE = 0.5
GOOD, BAD, SHORT, NEAR = "good", "bad", "short", "near"
FURNITURE = re.compile(r"©|\ball rights reserved\b", re.I)
#: Bare calls to act and bookkeeping lines, without the end of a sentence.
CALLS = re.compile(r"(?:\d+\s*min(?:utes?)?\s+read|(?:sign|log)\s?(?:up|in)\b[^.!?]{0,40}|(?:subscribe|follow us|share this|advertisement)\b[^.!?]{0,40}|(?:tags?|categor(?:y|ies)|filed under|posted in)\s*:[^.!?]{0,200})\Z", re.I)
SENTENCE_END = re.compile(r"[.!?…:][\"'»”’)\]]*\W*\Z")
WORDS = re.compile(r"\w+")


class Container:
    """An element that may be furniture: 'hold' and 'others' close with their end tag, 'loose' also where an article starts; 'form' and named ones may be wrappers."""

    __slots__ = ("body", "chars", "kind", "named")

    def __init__(self, kind: str, named: bool):
        self.kind, self.named, self.body, self.chars = kind, named, False, 0

    def furniture(self, prose: int) -> bool:
        if self.kind == "weak":
            return False
        wraps = self.chars >= BODY_SHARE * prose > 0
        return not (wraps and (self.kind == "form" or self.named and self.kind == "loose" and self.body))


class Block:
    __slots__ = ("article", "density", "holders", "label", "linked", "says", "text")

    def __init__(self, text: str, linked: int, tag: str, article: bool, holders: tuple[Container, ...]):
        self.text, self.linked, self.article, self.holders, self.label = text, linked, article, holders, SHORT
        self.says = tag in SAYING_TAGS or bool(SENTENCE_END.search(text))
        self.density = -1.0

    def stops(self) -> float:
        if self.density < 0:
            self.density = stop_density(self.text)
        return self.density

    def prose(self) -> bool:
        return len(self.text) >= LENGTH_LOW and self.linked <= LINKS_MAX * len(self.text) and self.stops() >= STOPS_LOW


def name_kind(name: str) -> str:
    """What one class or id name says of its element: a kind of container, or nothing."""
    words = [w.lower() for w in WORD_OF_NAME.findall(name)]
    telling = [w for w in words if w not in PLAIN_WORDS and not w.isdigit()]
    if not telling:
        return ""
    if all(w in COMMENT_NAMES for w in telling):
        return "hold"
    if not all(w in SKIP_NAMES or w in OTHERS_NAMES or w in COMMENT_NAMES or w in WEAK_NAMES for w in telling):
        return ""
    if any(w in OTHERS_NAMES for w in telling):
        return "others"
    return "weak" if all(w in WEAK_NAMES for w in telling) else "loose"


def container_of(tag: str, attrs: str, in_article: bool) -> Container | None:
    names: list[str] = []
    role = ""
    if attrs and ("=" in attrs or "hidden" in attrs):
        for name, a, b, c in ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                names += value.split()
            elif name == "role":
                role = value.lower()
            elif name == "hidden" and not value.lower().strip("hiden") or name == "aria-hidden" and value.lower() == "true":
                return Container("hidden", False)
    if tag in ("html", "body"):
        return None
    kinds = {name_kind(n) for n in names}
    if "hold" in kinds or tag in HOLD_TAGS or role in HOLD_ROLES:
        return Container("hold", False)
    if tag in ("form", "fieldset") or role in ("form", "search"):
        return Container("form", False)
    if tag in FIELD_TAGS:
        return Container("hidden", False)
    if tag == "header":
        return Container("headings" if in_article else "loose", False)
    if tag not in ("article", "main"):
        for kind in ("others", "loose", "weak"):
            if kind in kinds:
                return Container(kind, True)
    return None


class Scanner:
    """One walk over a page: open elements with their places, so every tag costs the same however many are open."""

    def __init__(self) -> None:
        self.out: list[Block] = []
        self.stack: list[tuple[str, Container | None]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of open block elements
        self.walls: list[int] = []  # the same without paragraphs
        self.holders: tuple[Container, ...] = ()
        self.articles = self.links = self.linked = 0
        self.parts: list[str] = []

    def flush(self) -> None:
        if self.parts:
            text = " ".join(unescape("".join(self.parts)).split())
            self.parts.clear()
            if text:
                tag = self.stack[self.blocks[-1]][0] if self.blocks else ""
                self.out.append(Block(text, min(self.linked, len(text)), tag, self.articles > 0, self.holders))
        self.linked = 0

    def push(self, tag: str, holder: Container | None) -> None:
        place = len(self.stack)
        self.stack.append((tag, holder))
        self.places.setdefault(tag, []).append(place)
        if tag in BLOCK_TAGS:
            self.blocks.append(place)
            if tag != "p":
                self.walls.append(place)
        if holder:
            self.holders = (*self.holders, holder)
        self.articles += tag in ("article", "main")
        self.links += tag == "a"

    def pop(self) -> None:
        tag, holder = self.stack.pop()
        self.places[tag].pop()
        if tag in BLOCK_TAGS:
            self.blocks.pop()
            if tag != "p":
                self.walls.pop()
        if holder:
            self.holders = self.holders[:-1]
        self.articles -= tag in ("article", "main")
        self.links -= tag == "a"

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            self.pop()

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1

    def close(self, tag: str) -> None:
        place = self.last(tag)
        if place < 0:
            return
        wall = self.walls[-1] if self.walls else -1
        if tag == "p" and wall > place:
            return  # a paragraph's end closes inline elements only
        if tag not in BLOCK_TAGS and tag != "a" and self.blocks and self.blocks[-1] > place:
            return  # an inline end tag does not close blocks
        self.pop_to(place)

    def open(self, tag: str, attrs: str) -> None:
        if tag == "body":
            head = self.last("head")
            if head >= 0:
                self.pop_to(head)
        wall = self.walls[-1] if self.walls else -1
        if tag == "p" or tag in HEADINGS:  # a paragraph or heading ends the open paragraph
            if self.last("p") > wall:
                self.pop_to(self.places["p"][-1])
            if wall >= 0 and self.stack[wall][0] in HEADINGS:
                self.pop_to(wall)
        if tag in ITEM_TAGS and wall >= 0 and self.stack[wall][0] == tag:
            self.pop_to(wall)
        holder = Container("hidden", False) if tag == "head" else container_of(tag, attrs, self.articles > 0)
        if tag in ("article", "main") and not holder:
            if self.holders and all(h.kind == "loose" for h in self.holders):  # an advert or notice left open ends where the article starts
                self.pop_to(next(k for k, (_, h) in enumerate(self.stack) if h))
        if tag in ("article", "main", "h1"):
            for h in self.holders:
                h.body = True
        self.push(tag, holder)

    def scan(self, html: str) -> list[Block]:
        for m in TOKEN.finditer(html):
            text = m.group("text")
            if text is not None:
                self.parts.append(text)
                if self.links:
                    self.linked += len(text.strip())
                continue
            tag = m.group("tag") or m.group("odd")
            if tag is None:
                if m.group("raw"):
                    self.parts.append(" ")
                continue
            if not m.group(0).endswith(">"):
                break  # cut off by the page's end
            tag = tag.lower()
            if tag == "br":
                self.parts.append(" ")
                continue
            if tag in BLOCK_TAGS or tag in FIELD_TAGS:
                self.flush()
            if m.group(0)[1] == "/":
                self.close(tag)
            elif tag not in VOID_TAGS:
                self.open(tag, m.group("attrs") or "")
        self.flush()
        return self.out


def blocks_of(html: str) -> list[Block]:
    """All blocks in page order; those inside furniture are labelled bad."""
    blocks = Scanner().scan(html)
    prose = 0
    for b in blocks:
        if b.holders and all(h.kind in ("hold", "hidden") for h in b.holders) or not b.prose():
            continue
        prose += len(b.text)
        for h in b.holders:
            h.chars += len(b.text)
    for b in blocks:
        for h in b.holders:
            if h.kind == "headings" and b.text and b.says and not SENTENCE_END.search(b.text):
                continue  # the heading of an article stands in its header
            if h.furniture(prose):
                b.label = BAD
                break
    return blocks


def classify(blocks: list[Block]) -> list[Block]:
    """The two passes; returns the blocks labelled good, in page order."""
    inside = sum(len(b.text) for b in blocks if b.label != BAD and b.article and b.prose())
    outside = sum(len(b.text) for b in blocks if b.label != BAD and not b.article and b.prose())
    held = any(b.article and b.label != BAD for b in blocks)
    within = held and inside >= outside
    labels = [first_pass(b, within) for b in blocks]
    own = [label if b.article and b.label != BAD and not CALLS.match(b.text) else SHORT for b, label in zip(blocks, labels, strict=True)]
    around, inner = neighbours(labels), neighbours(own)
    for k, b in enumerate(blocks):
        b.label = labels[k]
        if b.label in (GOOD, BAD):
            continue
        if within and b.says and not any(h.kind == "weak" for h in b.holders):
            b.label = BAD if inner[k][0][0] == inner[k][1][0] == BAD else GOOD
            continue
        (left, left_far), (right, right_far) = around[k]
        if left and right and left != right:
            near = left if left_far < right_far else right if right_far < left_far else GOOD if b.says else BAD
            b.label = GOOD if labels[k] == NEAR else near
        else:
            b.label = left or right or GOOD
    return [b for b in blocks if b.label == GOOD]


def first_pass(b: Block, within: bool) -> str:
    if b.label == BAD:
        return BAD
    size, density = len(b.text), b.linked / len(b.text)
    if CALLS.match(b.text):
        return BAD
    if within and not any(h.kind == "weak" for h in b.holders):
        if not b.article or density > LINKS_MAX_ARTICLE:
            return BAD
        return SHORT if size < LENGTH_LOW else GOOD if b.stops() >= STOPS_LOW else NEAR
    if within and not b.article or density > LINKS_MAX or FURNITURE.search(b.text) and size < LENGTH_HIGH:
        return BAD
    if size < LENGTH_LOW:
        return BAD if b.linked else SHORT
    stops = b.stops()
    if stops < STOPS_LOW:
        return NEAR if size > LENGTH_HIGH else SHORT
    return GOOD if size > LENGTH_HIGH or stops >= STOPS_HIGH else NEAR


def neighbours(labels: list[str]) -> list[tuple[tuple[str, int], tuple[str, int]]]:
    """The nearest decided label on either side of every block, with its distance."""

    def side(order: range) -> list[tuple[str, int]]:
        out, last, far = [("", 0)] * len(labels), "", 0
        for k in order:
            far += 1
            out[k] = (last, far)
            if labels[k] in (GOOD, BAD):
                last, far = labels[k], 0
        return out

    return list(zip(side(range(len(labels))), side(range(len(labels) - 1, -1, -1)), strict=True))


def stop_density(text: str) -> float:
    words = WORDS.findall(text.lower())
    return sum(map(STOP_WORDS.__contains__, words)) / len(words) if words else 0.0


def main_text(html: str | None) -> str:
    return "\n".join(b.text for b in classify(blocks_of(html))) if html else ""


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page id, url, text, n_chars, n_blocks) of every page; ``n_blocks`` counts the blocks kept."""
    small_batches(df.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())], names=["id", "url", "text", "n_chars", "n_blocks"]
            )

    source = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    id_type, url_type = (source.schema[c].dataType.simpleString() for c in ("id", "url"))
    return source.mapInArrow(extract, f"id {id_type}, url {url_type}, text string, n_chars bigint, n_blocks bigint").withColumnsRenamed({"id": id_col, "url": url_col})
