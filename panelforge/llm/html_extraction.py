"""Operator 7: main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelforge.llm.registry import query, table

# A tag whose quotes don't close ends at its first ">".
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+(?=>|$)|[^>]*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][^\s=/>\"']*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Elements whose content is no markup, those that have no content, and those that stand in a line of text.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
          "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "br", "wbr", "ruby",
          "rb", "rt", "rp"}
# Elements that an element of the same or a sibling kind closes, up to the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"},
         "thead": {"table"}, "tbody": {"table"}}
# Elements, roles and words of a class or id that mark what isn't the article.
ASIDE_TAGS = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "svg", "object", "audio", "video", "canvas", "head"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu",
               "menubar", "toolbar"}
ASIDE_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "banner", "promo", "promotion",
               "sponsor", "sponsored", "sidebar", "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond",
               "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "nav", "navbar", "navigation", "menu", "topnav",
               "footer", "header", "masthead", "topbar", "breadcrumb", "breadcrumbs", "share", "sharing", "social", "related",
               "recommended", "newsletter", "subscribe", "subscription", "signup", "popup", "modal", "overlay", "widget", "toolbar", "pagination",
               "pager", "login", "search", "skip", "copyright", "disclaimer"}
# Marks of a page's layout, which may also stand on what holds the whole page, words that may as well name its topic, marks that hide
# a part of a line of text, and words before a mark that make it none.
LAYOUT_WORDS = {"sidebar", "nav", "navbar", "navigation", "menu", "topnav", "footer", "header", "masthead", "topbar", "banner", "toolbar",
                "overlay", "modal", "search", "login", "widget"}
TOPIC_WORDS = LAYOUT_WORDS | {"advertising", "alert", "copyright", "promotion", "recommended", "related", "share", "sharing", "social",
                              "sponsor", "subscription", "reply", "respond", "notice", "notices", "skip"}
LINE_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "promo", "sponsor", "sponsored"}
NO_MARK = {"no", "has", "with", "without"}
CONTAINERS = ("section", "div", "td", "body", "blockquote")
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


# Grades of a mark: an aside whatever it holds; one that may turn out to hold the page; one that may turn out to be its topic.
ASIDE, WRAPPER, TOPIC = 1, 2, 3


@dataclass
class Element:
    """Elements are numbered in page order, so that a parent comes before what it holds; equal paths have equal numbers."""

    tag: str
    mark: int
    parent: int
    path: int
    in_article: bool


@dataclass
class Block:
    element: int
    text: str
    linked: int


def _is_aside(tag: str, attributes: dict[str, str], within_article: bool) -> bool:
    if tag in ASIDE_TAGS or attributes.get("role", "").lower() in ASIDE_ROLES or "hidden" in attributes:
        return True
    if tag == "header":
        return not within_article
    if tag in ("html", "body", "main", "article"):
        return False
    words = _mark_words(attributes)
    return bool(words) and not (words == {"header"} and within_article)


def _mark_words(attributes: dict[str, str]) -> set[str]:
    """Words of class and id that mark an aside; `no-sidebar` or `has-header` marks none."""
    found = set()
    for name in ("class", "id"):
        for one in attributes.get(name, "").split():
            words = [w.lower() for w in _CAMEL.findall(one)]
            found |= {w for before, w in zip(["", *words], words) if w in ASIDE_WORDS and before not in NO_MARK}
    return found


def _mark(tag: str, attributes: dict[str, str], within_article: bool) -> int:
    """Grade of an element's mark, 0 without one."""
    if not _is_aside(tag, attributes, within_article):
        return 0
    by_role = attributes.get("role", "").lower() in ASIDE_ROLES - {"form"} or "hidden" in attributes
    if by_role or tag != "form" and tag in ASIDE_TAGS | {"header"}:
        return ASIDE
    words = _mark_words(attributes)
    return WRAPPER if words <= LAYOUT_WORDS else TOPIC if words <= TOPIC_WORDS else ASIDE


def _summed(elements: list[Element], own: list[float]) -> list[float]:
    """Sums over everything that an element holds."""
    total = list(own)
    for i in range(len(elements) - 1, 0, -1):
        total[elements[i].parent] += total[i]
    return total


def _inherited(elements: list[Element], own: list[bool]) -> list[bool]:
    """Whether an element or one that holds it is marked so."""
    found = list(own)
    for i in range(1, len(elements)):
        found[i] = found[i] or found[elements[i].parent]
    return found


def _asides(elements: list[Element], blocks: list[Block]) -> list[bool]:
    """Which elements stand in an aside.

    Forms and layout elements that hold an article, or three quarters of the text outside other asides, are none; neither
    are elements marked by a word that may name the page's topic, if they hold three quarters of the text.
    """
    marks = [e.mark for e in elements]
    holds = _summed(elements, [float(e.tag in ("article", "main")) for e in elements])
    for grade in (TOPIC, WRAPPER):
        other = _inherited(elements, [m not in (0, WRAPPER, grade) for m in marks])
        sizes = [0.0] * len(elements)
        for b in blocks:
            if not other[b.element]:
                sizes[b.element] += max(0, len(b.text) - b.linked)
        inside = _summed(elements, sizes)
        for i, m in enumerate(marks):
            if m == grade and (grade == WRAPPER and holds[i] or inside[i] >= 0.75 * inside[0] > 0):
                marks[i] = 0
    return _inherited(elements, [m > 0 for m in marks])


def _attributes(source: str) -> dict[str, str]:
    return {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in ATTRIBUTE.finditer(source)} if source.strip() else {}


def _hides(attributes: dict[str, str]) -> bool:
    """Whether an inline element is hidden or an advert."""
    return "hidden" in attributes or bool(_mark_words(attributes) & LINE_WORDS)


def parse(page: str) -> tuple[list[Element], list[Block]]:
    """Elements and blocks of text in page order, each block with the element that holds it.

    A block ends where an element that isn't inline begins or ends; a line break is white space.  Paths are made of
    elements that aren't inline, with their first class.  Adverts and hidden parts within a line are left out.
    """
    elements = [Element("", 0, 0, 0, False)]
    paths: dict[tuple[int, str], int] = {}
    opened: Counter[str] = Counter()
    stack, blocks, parts = [0], [], []
    links = linked = 0
    hidden = ""  # the kind of inline element that hides what stands in it, and how many of its kind are open
    n_hidden = 0
    at = 0

    def end_block() -> None:
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            blocks.append(Block(stack[-1], text, linked))
        parts, linked = [], 0

    def close(tag: str, holders: set[str] = frozenset()) -> None:
        if not opened[tag]:
            return
        for i in range(len(stack) - 1, 0, -1):
            found = elements[stack[i]].tag
            if found == tag:
                opened.subtract(elements[k].tag for k in stack[i:])
                del stack[i:]
                return
            if found in holders:
                return

    low = None
    while True:
        m = TOKEN.search(page, at)
        text = page[at:m.start() if m else len(page)]
        if text and not n_hidden:
            parts.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = max(m.end(), at + 1)
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA[") and not n_hidden:
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        if tag in INLINE:
            if n_hidden:
                n_hidden += 0 if tag != hidden else -1 if m[1] else 1
                continue
            if not m[1] and tag not in VOID and m[3].strip() and _hides(_attributes(m[3])):
                hidden, n_hidden = tag, 1
                continue
            if tag == "a":
                links = 0 if m[1] else 1
            elif tag == "br":
                parts.append(" ")
            continue
        end_block()
        if m[1]:
            close(tag)
            links = n_hidden = 0
            continue
        if tag in RAW:
            low = low if low is not None else page.lower()
            end = low.find("</" + tag, at)
            at = len(page) if end < 0 else end
            continue
        if tag in VOID:
            continue
        # A paragraph ends where another element that isn't inline begins; list items and cells end at their siblings.
        close("p", {"div", "td", "th", "li", "article", "section", "main", "blockquote", "figure", "aside", "nav", "footer", "header", "form"})
        for other in CLOSES.get(tag, ()):
            close(other, HOLDS[tag])
        attributes = _attributes(m[3])
        parent = elements[stack[-1]]
        kind = attributes.get("class", "").split()
        path = paths.setdefault((parent.path, tag + ("." + kind[0] if kind else "")), len(paths) + 1)
        inside = parent.in_article or parent.tag in ("article", "main")
        elements.append(Element(tag, _mark(tag, attributes, inside), stack[-1], path, inside))
        stack.append(len(elements) - 1)
        opened[tag] += 1
        if m[3].rstrip().endswith("/") and tag not in ("p", "div", "li"):
            stack.pop()
            opened[tag] -= 1
    end_block()
    return elements, blocks


def smoothed(x: np.ndarray, radius: int = 1) -> np.ndarray:
    """Gaussian smoothing over neighbouring blocks."""
    kernel = np.exp(-0.5 * np.arange(-radius, radius + 1) ** 2)
    edge = np.pad(x, radius, mode="edge")
    return np.convolve(edge, kernel / kernel.sum(), mode="valid")


def main_text(page: str | None) -> str:
    """The main text of a page: its blocks in page order, joined by line feeds; empty if there is none.

    Every tag path has a text ratio (characters per block, links not counted) and a punctuation ratio.  Both are given
    to the path's blocks, smoothed over neighbours and fused by their product; blocks at or above the mean are content.
    The article is the deepest element that holds three quarters of their text; it is returned whole, but for asides and,
    outside <article> and <main>, paths that are little but links.  Other articles that hold content are returned as well;
    on pages without <article> and <main>, other containers that do.  Navigation, footers, asides, forms, adverts, notices and comments are known by element, role,
    class and id and take no part.
    """
    if not page:
        return ""
    elements, blocks = parse(page)
    aside = _asides(elements, blocks)
    blocks = [b for b in blocks if not aside[b.element]]
    if not blocks:
        return ""
    paths: dict[int, list[float]] = {}
    for b in blocks:
        p = paths.setdefault(elements[b.element].path, [0.0, 0.0, 0.0, 0.0])
        p[0] += 1
        p[1] += max(0, len(b.text) - b.linked)
        p[2] += len(PUNCTUATION.findall(b.text))
        p[3] += min(b.linked, len(b.text))
    of = [paths[elements[b.element].path] for b in blocks]
    text_ratio = smoothed(np.array([p[1] / p[0] for p in of]))
    mark_ratio = smoothed(np.array([p[2] / p[0] for p in of]))
    fused = text_ratio * (mark_ratio + 0.1)
    content = [b for b, f in zip(blocks, fused, strict=True) if f >= fused.mean() * (1 - 1e-9)]

    sizes = [0.0] * len(elements)
    for b in content:
        sizes[b.element] += max(1, len(b.text) - b.linked)
    sizes = _summed(elements, sizes)
    deepest = 0
    for i, e in enumerate(elements):  # those that hold three quarters lie on one path, in page order
        if sizes[i] >= 0.75 * sizes[0]:
            deepest = i

    def nearest(tags: tuple[str, ...]) -> list[int]:
        """For every element the nearest of these kinds that holds it, or itself; the root without one."""
        found = [0] * len(elements)
        for i in range(1, len(elements)):
            found[i] = i if elements[i].tag in tags else found[elements[i].parent]
        return found

    # A single long paragraph is not the article: what holds it is, up to the nearest container.  Headings of an article
    # stand beside the element that holds its paragraphs.
    deepest = nearest(("article", "main", *CONTAINERS))[deepest]
    article = nearest(("article",))
    marked = article[deepest] or nearest(("main",))[deepest]
    others = article if marked else nearest(CONTAINERS)
    chosen = [False] * len(elements)
    chosen[marked or deepest] = True
    for b in content:
        if others[b.element] or not marked:
            chosen[others[b.element]] = True
    chosen = _inherited(elements, chosen)

    def is_menu(b: Block) -> bool:
        e = elements[b.element]
        _, plain, marks, linked = paths[e.path]
        return not marked and e.tag == "li" and linked > 4 * plain and marks < 1 + linked / 80

    return "\n".join(b.text for b in blocks if chosen[b.element] and not is_menu(b))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Add `text` and `n_chars` (its code points) to every row; the html column is left out, the others stay.

    A null or empty page has an empty text.  Input columns named like an output are replaced.  Narrow: no shuffle.
    """
    rest = [c for c in pages.columns if c not in ("text", "n_chars", html_col)]
    df = pages.select(*[pages[c] for c in rest], pages[html_col].cast("string").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p) for p in b.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=[*rest, "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1])
    return df.mapInArrow(run, f"{schema}{', ' if schema else ''}text string, n_chars bigint")


@query("op7_html_extraction")
def op7(spark, sf):
    return extract(table(spark, sf, "pages").select("page_id", "url", "html"))
