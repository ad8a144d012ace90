"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags; inline markup, comments, scripts and styles go.
Pass one labels blocks from their stop-word density, length and link density. Blocks inside
elements that by tag, role or class are page furniture (menus, footers, adverts, forms, reader
comments) are boilerplate. Inside a marked article the limits are lower, and a block below them
stays open. Short blocks stay open everywhere. Pass two gives an open block the label of its nearest decided
neighbour on either side: the deeper common container, then fewer blocks away, then the one that
follows. Furniture is no neighbour: it says nothing about the text around it. Open blocks of an
article look for neighbours within articles only, and stay without any.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element and class names, and stop words of four languages.
RAW = "script style template noscript textarea title svg math iframe object select".split()
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main "
    "menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul "
    "head".split()
)
FURNITURE_TAGS = set("nav aside footer form menu button dialog head fieldset search".split())
FURNITURE_ROLES = set(
    "navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar "
    "toolbar".split()
)
FURNITURE_NAMES = set(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot banner "
    "sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices alert "
    "popup modal overlay sidebar sidebars aside rail widget widgets menu menus nav navbar "
    "navigation breadcrumb breadcrumbs masthead topbar toolbar footer foot bottombar copyright "
    "comment comments commentlist replies respond disqus discussion share sharing social related "
    "recommended recommendations newsletter subscribe subscription signup login search searchbox "
    "form pagination pager tags disclaimer skip skiplink".split()
)
HEADER_NAMES = set("header head siteheader pageheader".split())
CONTENT_NAMES = set("article content main post story entry body maincontent".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
STOP_WORDS = set(
    "the of and to a in is that it for was on with be as by this at are from or an not have "
    "de la le et les des en un du une est que pour qui dans au sur pas par avec il ne se "
    "der die und den von zu das sich mit auf für ist nicht im eine dem ein als auch es an "
    "el y los del las con no para su al lo como más".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[(?P<cdata>.*?)\]\]>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^<>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>"
    r"|<[!?/][^>]*>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}
_WORD = re.compile(r"[^\W\d_]+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

GOOD, BAD, OPEN = 1, 0, None


@dataclass
class Block:
    text: str
    linked: int
    path: tuple[int, ...]
    furniture: bool
    article: bool
    heading: bool


@dataclass(frozen=True)
class Rules:
    """Limits of pass one. Lengths are in characters, densities are shares."""

    max_links: float = 0.5
    short: int = 70
    long: int = 200
    stop_low: float = 0.08
    stop_high: float = 0.2
    #: What the lengths and stop-word densities are multiplied by in a marked article.
    in_article: float = 0.5


class _Element:
    __slots__ = ("tag", "number", "furniture", "article")

    def __init__(self, tag, number, furniture, article):
        self.tag, self.number, self.furniture, self.article = tag, number, furniture, article


def _kind(tag: str, rest: str, within: _Element) -> tuple[bool, bool]:
    """(furniture, article) of an element that opens inside ``within``."""
    found = {}
    if rest and not rest.isspace():
        for name, *values in _ATTRIBUTE.findall(rest):
            found.setdefault(name.lower(), html.unescape("".join(values)))
    role = found.get("role", "").lower()
    names = set()
    for value in (found.get("class", ""), found.get("id", "")):
        for token in value.split():
            names.add(token.lower())
            names.update(part.lower() for part in _NAME.findall(token))
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    hidden |= "display:none" in found.get("style", "").replace(" ", "").lower()
    furniture = tag in FURNITURE_TAGS or role in FURNITURE_ROLES or hidden
    if tag not in ("html", "body", "main"):
        furniture |= bool(names & FURNITURE_NAMES)
    if not within.article:
        furniture |= tag == "header" or (bool(names & HEADER_NAMES) and tag in ("div", "section", "td"))
    marked = tag in ("article", "main") or role in ("main", "article")
    if tag in ("article", "main") and not names & FURNITURE_NAMES and not hidden:
        # An article inside a menu means the menu was never closed; in comments it is one more.
        furniture |= within.furniture and within.tag not in ("nav", "menu", "ul", "ol", "li", "header")
    else:
        furniture |= within.furniture
    return furniture, (within.article or marked) and not furniture


def page_blocks(page: str) -> list[Block]:
    """The non-empty blocks of a page in order."""
    stack = [_Element("", 0, False, False)]
    blocks: list[Block] = []
    parts: list[str] = []
    opened, links, linked, heading = 0, 0, 0, False

    def close_block():
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            top = stack[-1]
            blocks.append(
                Block(text, linked, tuple(e.number for e in stack[:64]), top.furniture, top.article, heading)
            )
        parts.clear()
        linked = 0

    def say(raw: str):
        nonlocal linked
        if raw:
            parts.append(html.unescape(raw) if "&" in raw else raw)
            if links:
                linked += len("".join(parts[-1].split()))

    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if not found:
            say(page[at:])
            break
        say(page[at : found.start()])
        at = found.end()
        if found["cdata"] is not None:
            continue
        tag = (found["tag"] or "").lower()
        if not tag:
            continue
        if found["end"]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS:
                close_block()
                if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                    heading = False
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        links = 0
                        break
            continue
        if tag in _RAW_END:
            if not found["rest"].endswith("/") or tag in ("script", "style", "title", "textarea"):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else size
            continue
        if tag == "a":
            links += 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS:
            close_block()
            if tag in VOID:
                continue
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack[-1].tag == tag:
                stack.pop()  # their end tags may be left out
            elif stack[-1].tag == "p":
                stack.pop()
            heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
            opened += 1
            stack.append(_Element(tag, opened, *_kind(tag, found["rest"], stack[-1])))
    close_block()
    return blocks


def first_labels(blocks: list[Block], rules: Rules) -> list[int | None]:
    labels = []
    for b in blocks:
        solid = len(b.text) - b.text.count(" ")
        links = b.linked / solid
        words = [w.lower() for w in _WORD.findall(b.text)]
        stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
        size = len(b.text)

        def dense(share: float, stops: float = stops, size: int = size) -> bool:
            if size < share * rules.short:
                return False
            low = stops >= share * rules.stop_low and size >= share * rules.long
            return low or stops >= share * rules.stop_high

        if b.furniture:
            label = BAD
        elif b.article:
            # A lone link may be a reference; a block of links in an article is open at most.
            good = links <= rules.max_links and not b.heading and dense(rules.in_article)
            label = GOOD if good else OPEN
        elif links > rules.max_links:
            label = BAD
        elif size < rules.short or b.heading:
            label = OPEN
        elif dense(1.0):
            label = GOOD
        elif stops >= rules.stop_low:
            label = OPEN
        else:
            label = BAD
        labels.append(label)
    return labels


def _shared(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def settled(blocks: list[Block], labels: list[int | None]) -> list[int]:
    """Open blocks take the label of the nearest decided one; without any, those of an article
    stay and others go."""
    n = len(blocks)
    before, after = [None] * n, [None] * n
    for order, nearest in ((range(n), before), (range(n - 1, -1, -1), after)):
        last, last_article = None, None
        for i in order:
            nearest[i] = last_article if blocks[i].article else last
            if labels[i] is not OPEN and not blocks[i].furniture:
                last = i
                last_article = i if blocks[i].article else last_article
    out = []
    for i, label in enumerate(labels):
        if label is OPEN:
            near = [
                (_shared(blocks[i].path, blocks[j].path), -abs(j - i), j)
                for j in (before[i], after[i])
                if j is not None
            ]
            if blocks[i].heading and after[i] is not None and labels[after[i]] == GOOD:
                label = GOOD
            else:
                label = labels[max(near)[2]] if near else (GOOD if blocks[i].article else BAD)
        out.append(label)
    return out


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    """The page's main text: kept blocks in order, two line ends between them."""
    if not page:
        return ""
    blocks = page_blocks(page)
    labels = settled(blocks, first_labels(blocks, rules))
    return "\n\n".join(b.text for b, label in zip(blocks, labels, strict=True) if label == GOOD)


def extract(
    pages: DataFrame,
    *,
    html_col: str = "html",
    keep: tuple[str, ...] = ("page_id", "url"),
    rules: Rules = Rules(),
) -> DataFrame:
    """The ``keep`` columns with ``text`` and ``n_chars`` (code points), one row per row.

    A NULL or empty page, and a page without main text, give an empty text. Repeated rows and
    NULLs in other columns are kept as they are; columns not named in ``keep`` are not read.
    """
    schema = T.StructType([pages.schema[c] for c in keep]).add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, rules) for p in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(keep)],
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=schema.names,
            )

    return pages.select(*keep, html_col).mapInArrow(run, schema)
