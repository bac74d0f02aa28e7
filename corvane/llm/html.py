"""Main text of web pages by tag-path ratios.

Text nodes are grouped into blocks, and blocks by their root-to-leaf tag path. Each path has two ratios: its text length
and its punctuation marks per block. Both are laid along the page, smoothed with a Gaussian, and fused into one value.
A path is further smoothed with what holds it: headings, paragraphs, list items and the like count as parts of the article
or main element around them, or else of the next element that is none of these, and take half of their value from all
text in there, so short lines beside long ones stay. What is link text counts nothing. Elements, roles and class names that speak of menus, adverts, comments
and the like are a weak feature: they lower a path's value by a factor. Paths whose value reaches a share of the page's
mean, weighed by text, are content; all their blocks are taken, and no others.

Left out beforehand is only what a reader doesn't see as text: scripts, styles, the head, controls of forms, hidden
elements. Pages are read row by row in linear time; nothing is shuffled.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm import common

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
# Element names of HTML by how they behave here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
UNSEEN = frozenset("head button select option optgroup datalist noscript svg math template dialog object canvas audio video".split())
AROUND = frozenset("nav footer aside form menu fieldset label legend".split())
LINES = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd blockquote pre td th caption figcaption summary address".split())
CLOSED_BY_SAME = frozenset("p li dt dd td th tr option".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "login masthead menu modal nav navbar navigation newsletter notice notification notifications pagination paywall popup promo promotion recommended related "
    "replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget header alert".split()
)
WHOLE = frozenset("html body article main".split())
MAIN = frozenset("article main".split())
PARTS = LINES | frozenset("table tbody thead tfoot tr colgroup ul ol dl".split())
MARKS = ".,;:!?"
#: Share of the mean that content reaches; factor of what is named like something beside the text, and the least value it needs.
SHARE, BESIDE, FLOOR, SIGMA = 0.25, 0.1, 200.0, 1.0


@dataclass
class Path:
    """A tag path: its parent, the path that its text is a part of, the article's, if any, and whether names on it speak of something beside the text."""

    parent: int
    tag: str
    holder: int
    article: int
    beside: bool


@dataclass
class Block:
    """Text between block boundaries, with its path and how much of it is link text."""

    path: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _attributes(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, str]:
    """Whether an element is hidden, whether it is named like something beside the text, and its class names in order."""
    beside = tag in AROUND or tag == "header" and not in_article
    if not attributes:
        return False, beside, ""
    hidden, classes = False, ""
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name in ("class", "id") and tag not in WHOLE:
            # a line is named as a whole only: header-note may well be a paragraph of the text
            beside = beside or not NAMES.isdisjoint(value.split() if tag in LINES else re.split(r"[^a-z0-9]+", value))
        if name == "class":
            classes = ".".join(sorted(set(value.split())))
        elif name == "role":
            beside = beside or value in ROLES
        elif name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    hidden = hidden or re.search(r"(?:^|\s)hidden(?:\s|$|/)", re.sub(ATTRIBUTE, "", attributes)) is not None
    return hidden, beside, classes


def blocks(page: str) -> tuple[list[Block], list[Path]]:
    """The blocks of a page that a reader sees, and their paths; a path comes after its parent."""
    found: list[Block] = []
    paths, number = [Path(-1, "", 0, -1, False)], {}
    #: tag, path, unseen, in an article, is inline
    stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
    opened: Counter[str] = Counter()
    links, current, at, end = 0, None, 0, len(page)
    last = page.rfind(">") + 1
    lower = None

    def text(x: str) -> None:
        nonlocal current
        if stack[-1][2] or not x:
            return
        if current is None:
            if x.isspace():
                return
            current = Block(stack[-1][1])
            found.append(current)
        current.parts.append(x)
        if links:
            current.linked += len(x.strip())

    def close(to: int) -> None:
        for x in stack[to:]:
            opened[x[0]] -= 1
        del stack[to:]

    while at < end:
        m = TOKEN.search(page, at, last)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if page.startswith("<!--", m.start()) and not page.endswith("-->", m.start(), at):
                break
            continue
        tag, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW:
            if not closing:
                lower = page.lower() if lower is None else lower
                stop = lower.find(f"</{tag}", at)
                at = end if stop < 0 else stop
            continue
        if tag == "br":
            text(" ")
            continue
        _, path, out, in_article, is_inline = stack[-1]
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            if not closing and attributes and tag not in VOID and _attributes(tag, attributes, True)[0]:
                stack.append((tag, path, True, in_article, True))
                opened[tag] += 1
            elif closing and is_inline and stack[-1][0] == tag:
                close(len(stack) - 1)
            continue
        current, links = None, 0
        if tag in VOID:
            continue
        if closing:
            if opened[tag]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            continue
        while len(stack) > 1 and (stack[-1][4] or tag in CLOSES_P and stack[-1][0] == "p" or tag in CLOSED_BY_SAME and stack[-1][0] == tag):
            close(len(stack) - 1)
        _, path, out, in_article, _ = stack[-1]
        hidden, beside, classes = _attributes(tag, attributes, in_article)
        beside = beside or paths[path].beside
        key = path, tag, classes, beside
        to = number.get(key)
        if to is None:
            to = number[key] = len(paths)
            article = to if tag in MAIN else paths[path].article
            holder = to if tag not in PARTS else article if article >= 0 else paths[path].holder
            paths.append(Path(path, tag, holder, article, beside))
        stack.append((tag, to, out or hidden or tag in UNSEEN, in_article or tag in MAIN, False))
        opened[tag] += 1
    kept = []
    for b in found:
        raw = "".join(b.parts)
        b.text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
        if b.text:
            b.linked = min(b.linked, len(b.text))
            kept.append(b)
    return kept, paths


def smoothed(values: list[float]) -> list[float]:
    """Along the page, with a Gaussian of radius 2; at the ends over what there is."""
    kernel = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(3)]
    out, n = [], len(values)
    for i in range(n):
        total = weight = 0.0
        for k in range(max(0, i - 2), min(n, i + 3)):
            w = kernel[abs(k - i)]
            total, weight = total + w * values[k], weight + w
        out.append(total / weight)
    return out


def content_paths(found: list[Block], paths: list[Path]) -> set[int]:
    """The paths that are content."""
    own: dict[int, list[int]] = {}  # blocks, characters, marks, characters of links
    for b in found:
        x = own.setdefault(b.path, [0, 0, 0, 0])
        for k, v in enumerate((1, len(b.text), sum(map(b.text.count, MARKS)), b.linked)):
            x[k] += v
    # all text in a path but that of an article inside it; html and body only have their own lines
    inside = [[0, 0, 0] for _ in paths]
    for k in range(len(paths) - 1, -1, -1):
        for i, v in enumerate(own.get(k, ())[:3]):
            inside[k][i] += v
        up = paths[k].parent
        if up >= 0 and paths[k].tag not in MAIN and (paths[up].tag not in ("", "html", "body") or paths[k].tag in PARTS):
            for i, v in enumerate(inside[k]):
                inside[up][i] += v
    lengths = smoothed([own[b.path][1] / own[b.path][0] for b in found])
    marks = smoothed([own[b.path][2] / own[b.path][0] for b in found])
    value = dict.fromkeys(own, 0.0)
    for b, length, mark in zip(found, lengths, marks):
        value[b.path] += length * (1 + mark)
    for k, (n, length, _, linked) in own.items():
        m, all_length, all_marks = inside[paths[k].holder]
        around = all_length / m * (1 + all_marks / m)
        value[k] = (value[k] / n + around) / 2 * (1 - linked / length) * (BESIDE if paths[k].beside else 1)

    def mean(some: list[int]) -> float:
        total = sum(own[k][1] for k in some)
        return sum(value[k] * own[k][1] for k in some) / total if total else 0.0

    level = SHARE * max(mean(list(own)), mean([k for k in own if not paths[k].beside]))
    return {k for k, (_, length, _, linked) in own.items() if value[k] >= level and 2 * linked <= length and (not paths[k].beside or value[k] >= FLOOR)}


def extract(page: str | None) -> str:
    """The main text of a page, a line for each block; empty for none."""
    found, paths = blocks(page or "")
    if not found:
        return ""
    good = content_paths(found, paths)
    return "\n".join(b.text for b in found if b.path in good)


def main_text(pages: DataFrame) -> DataFrame:
    """``pages`` (html and any more columns) with ``text`` and ``n_chars`` in place of html.

    A null, empty or text-free page has an empty text. Columns of the two names are replaced; repeated rows stay.
    """
    others = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    schema = pages.select(others).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 200):
                part = b.slice(at, 200)
                texts = [extract(x) for x in part["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in others), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*others, "text", "n_chars"])

    return pages.select(*others, "html").mapInArrow(common.released(run), schema)
