"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  Furniture (menus, footers, forms,
comments) goes at once.  The first pass decides what it can from a block's link
density, its length and its share of stop words, inside and outside an article or
main element alike.  Stop words count only where they are at least ``FEW_STOPS`` of
the page's words, so not in languages that the list lacks, and not in listings and
tables; there length and links decide.  Other blocks stay ambiguous; the second
pass gives them the label of their nearest decided neighbours.

What an article or main element decides: inside it, few stop words alone reject
nothing, and one short link is ambiguous; blocks of several links, long ones that are
links, and rows of ``ROW`` links or more are rejected there as elsewhere.  Neighbours
count only on the same side of its border, and where a side has none that is decided,
the inside stays, unless text was found outside only; the outside goes, unless its
middling blocks hold more text than all articles do.

A mark of layout (a sidebar, a header) on a wrapper of an article is none, unless
another article stands outside such wrappers.  Inside articles, header names are none.

Null, empty and textless pages give an empty text.  Unclosed and stray tags are
repaired by nesting; an unclosed comment or script runs to the end of the page.
Pages are treated one by one, so repeated rows and null ids change nothing, and
a page is read whole, in time linear in its length.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import tidy

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|select)\b[^>]*+(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|</?[a-zA-Z][^<>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[^\W\d_]+")

# Elements of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_CLOSES_P = _BLOCKS - {"option"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FURNITURE = frozenset("head nav footer aside form button menu dialog title fieldset".split())
_ARTICLE = frozenset({"article", "main"})
_UNMARKED = _ARTICLE | {"html", "body"}
_LISTINGS = frozenset({"pre", "table"})
_HEADERS = frozenset({"header", "masthead"})
_LAYOUT = _HEADERS | frozenset("sidebar sidebars aside banner nav navbar navigation navigations menu menus widget widgets toolbar".split())

# Parts of class, id and role names that mark furniture.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert disclaimer "
    "sidebar sidebars aside menu menus nav navbar navigation navigations breadcrumb breadcrumbs header masthead footer copyright legal "
    "comment comments commentlist disqus respond reply replies share sharing social related recommended newsletter subscribe subscription signup login "
    "popup modal widget widgets toolbar pagination pager search form contentinfo complementary hidden".split()
)

# What names of furniture add to a mark.
_PLACES = frozenset("site page main global top bottom left right primary secondary list bar box links link area section block posts post items item wrap wrapper container".split())

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their there they this to was we were which with you "
    "aber als am an auch auf aus bei das dass dem den der des die du ein eine einem einen einer es für hat ich im in ist mit nach nicht noch sich sie sind so über um und von war wie wir zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con de del el ella en entre era es esta este la las lo los más no o para pero por que se si sin sobre su sus un una y ya".split()
)

SHORT = 70
LONG = 200
LINKS = 0.5
SOME_LINKS = 0.25
ROW = 3
FEW_STOPS = 0.12
MANY_STOPS = 0.25

GOOD, BAD, MIDDLING, SHORTISH = "good", "bad", "middling", "short"


@dataclass
class Block:
    text: str
    linked: int
    article: bool
    listing: bool = False
    anchors: int = 0
    lifted: bool = False  # its article stands inside a wrapper marked as layout

    def link_density(self) -> float:
        return self.linked / len(self.text)

    def stop_density(self) -> float:
        words = _WORD.findall(self.text.lower())
        return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _marks(attributes: str) -> set[str]:
    """The marks among a class, id or role; names count that are made of marks and ``_PLACES`` only."""
    out: set[str] = set()
    for m in _NAMED.finditer(attributes):
        for token in m[m.lastindex].lower().split():
            parts = {p for p in re.split(r"[^a-z]+", token) if p}
            if parts <= _MARKS | _PLACES:
                out |= parts & _MARKS
    return out


@dataclass(frozen=True)
class _Open:
    """An open element, and what holds for all that is inside it."""

    name: str
    furniture: bool = False
    article: bool = False
    framed: bool = False  # inside an element that is furniture by its name
    layout: bool = False  # furniture by marks of layout alone
    lifted: bool = False
    links: int = 0
    listings: int = 0
    block: int = -1  # where the innermost block that is no paragraph stands


class _Stack:
    """Open elements; every step costs as much as it opens and closes, however deep they nest."""

    def __init__(self) -> None:
        self.items: list[_Open] = []
        self.places: dict[str, list[int]] = defaultdict(list)

    def top(self) -> _Open:
        return self.items[-1] if self.items else _Open("")

    def push(self, item: _Open) -> None:
        self.places[item.name].append(len(self.items))
        self.items.append(item)

    def cut(self, low: int) -> None:
        while len(self.items) > low:
            self.places[self.items.pop().name].pop()

    def end(self, name: str) -> None:
        """A stray end tag closes nothing; others close what is open inside, but no block closes with an inline element."""
        places = self.places.get(name)
        if not places:
            return
        paragraphs = self.places.get("p") or [-1]
        if name in _BLOCKS or places[-1] > max(self.top().block, paragraphs[-1]):
            self.cut(places[-1])

    def begin(self, name: str) -> None:
        """What ends where this element begins: its siblings, and paragraphs with the inline elements left open in them."""
        top = self.top()
        if name in _CLOSES_P and top.name == "p" or top.name in _SIBLINGS.get(name, ()):
            self.cut(len(self.items) - 1)
        elif name in _CLOSES_P and (places := self.places.get("p")):
            k = bisect.bisect_right(places, top.block)
            if k < len(places):
                self.cut(places[k])


def page_blocks(page: str) -> list[Block]:
    """The blocks outside furniture, in page order."""
    blocks: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    linked = anchors = 0

    def ended() -> None:
        nonlocal linked, anchors
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append(Block(text, min(linked, len(text)), stack.top().article, stack.top().listings > 0, anchors, stack.top().lifted))
            parts.clear()
        linked = anchors = 0

    def told(raw: str) -> None:
        nonlocal linked
        top = stack.top()
        if raw and not top.furniture:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if top.links:
                linked += len(text.strip())

    last = 0
    for m in _TAG.finditer(page):
        if m.start() > last:
            told(page[last : m.start()])
        last = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if name == "br":
            if not stack.top().furniture:
                parts.append(" ")
            continue
        if name in _BLOCKS:
            ended()
        if m["close"]:
            stack.end(name)
            continue
        if name in _VOID:
            continue
        stack.begin(name)
        top = stack.top()
        frame = name in _FURNITURE or name == "header"
        marks = _marks(m["attributes"]) if name not in _UNMARKED and m["attributes"].strip() else set()
        if top.article:
            marks -= _HEADERS
        framing = name in _FURNITURE or name == "header" and not top.article
        own = framing or bool(marks)
        if m["attributes"].rstrip().endswith("/") and name not in _BLOCKS:
            continue
        # a mark on a wrapper of the main element is none; one of layout may be none on a wrapper of an article
        lifted = name in _ARTICLE and top.layout and not top.framed
        freed = name == "main" and not top.framed or lifted
        layout = not framing and marks <= _LAYOUT and (top.layout or not top.furniture) if own else top.layout and not freed
        block = len(stack.items) if name in _BLOCKS and name != "p" else top.block
        if name == "a" and not top.furniture:
            anchors += 1
        article = (top.article or name in _ARTICLE) and not own
        stack.push(_Open(name, top.furniture and not freed or own, article, top.framed or frame, layout, article and (top.lifted or lifted and name != "main"), top.links + (name == "a"), top.listings + (name in _LISTINGS), block))
    told(page[last:])
    ended()
    if any(b.article and not b.lifted for b in blocks):
        return [b for b in blocks if not b.lifted]
    return blocks


def first_pass(block: Block, covered: bool) -> str:
    """The label of a block; ``covered``: whether stop words tell anything of the page."""
    density = block.link_density()
    if density > LINKS:
        return SHORTISH if block.article and block.anchors < 2 and len(block.text) < SHORT else BAD
    if len(block.text) < SHORT:
        return SHORTISH
    stops = block.stop_density()
    if block.listing or not covered:
        stops = MANY_STOPS
    if stops >= MANY_STOPS:
        return GOOD if len(block.text) >= LONG else MIDDLING
    return MIDDLING if stops >= FEW_STOPS or block.article and density <= SOME_LINKS else BAD


def rows_of_links(blocks: list[Block], labels: list[str]) -> list[str]:
    """The labels, with links that follow each other ``ROW`` times or more rejected: lists of other pages."""
    out, low = list(labels), 0
    for k in range(len(blocks) + 1):
        if k == len(blocks) or blocks[k].link_density() <= LINKS:
            if k - low >= ROW:
                out[low:k] = [BAD] * (k - low)
            low = k + 1
    return out


def stop_words_tell(blocks: list[Block]) -> bool:
    words = [w for b in blocks if b.link_density() <= LINKS and not b.listing for w in _WORD.findall(b.text.lower())]
    return sum(w in STOP_WORDS for w in words) >= FEW_STOPS * len(words)


def second_pass(labels: list[str]) -> list[bool]:
    """Which blocks are text: ambiguous ones follow their nearest decided neighbours."""
    count = len(labels)
    before, after = [None] * count, [None] * count
    near = None
    for k in range(count):
        before[k] = near
        if labels[k] in (GOOD, BAD):
            near = (labels[k], k)
    near = None
    for k in range(count - 1, -1, -1):
        after[k] = near
        if labels[k] in (GOOD, BAD):
            near = (labels[k], k)
    out = []
    for k, label in enumerate(labels):
        if label in (GOOD, BAD):
            out.append(label == GOOD)
            continue
        sides = [s for s in (before[k], after[k]) if s]
        if not sides:
            out.append(label == MIDDLING)
        elif len({s[0] for s in sides}) == 1:
            out.append(sides[0][0] == GOOD)
        elif label == MIDDLING:
            out.append(True)
        else:
            nearest = min(sides, key=lambda s: (abs(s[1] - k), s[0] != GOOD))
            out.append(nearest[0] == GOOD)
    return out


def chosen(blocks: list[Block]) -> list[bool]:
    """Which blocks are text, by both passes."""
    covered = stop_words_tell(blocks)
    labels = rows_of_links(blocks, [first_pass(b, covered) for b in blocks])
    if not any(b.article for b in blocks):
        if set(labels) == {SHORTISH}:
            # nothing to go by: what isn't linked stays
            return [b.linked == 0 for b in blocks]
        return second_pass(labels)
    found = {b.article for b, label in zip(blocks, labels, strict=True) if label == GOOD}
    inside = sum(len(b.text) - b.linked for b in blocks if b.article)
    outside = sum(len(b.text) for b, label in zip(blocks, labels, strict=True) if not b.article and label == MIDDLING)
    inside_stays = True in found or not (False in found or outside > inside)
    out: list[bool] = []
    while len(out) < len(blocks):
        first = len(out)
        article = blocks[first].article
        last = next((k for k in range(first, len(blocks)) if blocks[k].article != article), len(blocks))
        side = labels[first:last]
        if GOOD in side or BAD in side and not article:
            out += second_pass(side)
        elif article:
            out += [inside_stays and label != BAD for label in side]
        else:
            out += [label == MIDDLING and outside > inside for label in side]
    return out


def main_text(page: str | None) -> str:
    blocks = page_blocks(page or "")
    return "\n".join(b.text for b, k in zip(blocks, chosen(blocks), strict=True) if k)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), *batch.columns[1:]], names=["text", "n_chars", *batch.schema.names[1:]])


def extracted(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` of each page, then its text and n_chars (code points)."""
    rows = pages.select(pages[html_col].alias("html"), *(pages[c].alias(f"kept_{k}") for k, c in enumerate(keep)))
    schema = "text string, n_chars long" + "".join(f", kept_{k} {rows.schema[f'kept_{k}'].dataType.simpleString()}" for k in range(len(keep)))
    return rows.mapInArrow(partial(tidy, _extracted), schema).select(*(F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)), "text", "n_chars")
