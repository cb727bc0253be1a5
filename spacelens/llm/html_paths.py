"""Main text of web pages by tag-path ratios.

A page is read once into text nodes; a node belongs to its block (paragraph, heading, list item
...) and the block has a path of tags from the root. Blocks inside parts that are never content by
their own markup (scripts, styles, forms, navigation, footers, and elements whose class, id or role
says menu, advert, notice, sidebar, comments ...) are set aside. Over the rest:

1. per path, the text length and the punctuation of its blocks are added up and divided by the
   number of blocks, link text counting against it: the path's two ratios;
2. either ratio is smoothed over the paths of the page, each path weighing by how much of its
   root-to-leaf way it shares;
3. the two are fused by product into one score per path;
4. paths scoring at least ``threshold`` of the best path are content, wherever they lie; every
   article or main around one of them (without any, the parent of the best path) lifts the other
   paths below it, in its parts too. Paths with more text in links than outside are not content
   unless no other path is.

Content blocks come out in page order, their character references decoded and white space turned
into single spaces, joined by a blank line.

Defined cases: null and empty html give an empty text; a page without any markup is one block; a
tag, comment or script cut off by the end of the page is dropped; unknown and unclosed tags nest
as they come; repeated rows are worked on alike; an empty table gives an empty result;
``main_text`` replaces an input column of that name.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Element names of HTML by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset(
    "script style noscript template svg math canvas object iframe head title nav aside footer form"
    " button select textarea input dialog menu audio video".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby"
    " rb rt rp s samp small span strike strong sub sup time tt u var wbr".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main".split())
# A start tag of these closes an open paragraph.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2"
    " h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
# Words in class, id and role that mark a part as something other than the article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo"
    " promotion nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager header"
    " masthead topbar footer colophon contentinfo sidebar aside complementary widget cookie cookies"
    " consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription"
    " signup login search share sharing social related recommended comment comments commentlist"
    " disqus respond reply replies".split()
)

#: As in browsers, elements nested deeper count as lying at this depth.
DEEPEST = 512

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME_PART = re.compile(r"[A-Za-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")


@dataclass(frozen=True)
class PathConfig:
    """sigma: width of the smoothing, in unshared parts of paths; threshold: share of the best score."""

    sigma: float = 0.2
    threshold: float = 0.2


@dataclass
class Block:
    path: tuple[str, ...]
    pieces: list[str]
    linked: int
    aside: bool
    #: Numbers of the articles and mains around it, outermost first.
    containers: tuple[int, ...]

    def text(self) -> str:
        return _SPACE.sub(" ", html.unescape("".join(self.pieces))).strip()


def _said(attributes: str) -> tuple[bool, str]:
    """Whether the attributes set an element aside, and the class part of its path name."""
    aside, label = False, ""
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            aside = True
            continue
        parts = {p.lower() for p in _NAME_PART.findall(_CAMEL.sub(" ", value)) + _NAME_PART.findall(value)}
        aside = aside or bool(parts & ASIDE_WORDS)
        if name == "class" and not label:
            label = "." + value.split(" ")[0] if value else ""
    return aside, label


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order."""
    found: list[Block] = []
    # Open elements: (tag, name in a path, set aside, numbers of the articles and mains).
    stack: list[tuple[str, str, bool, tuple[int, ...]]] = []
    current: Block | None = None
    containers = 0
    links = 0

    def add(text: str) -> None:
        nonlocal current
        if not text:
            return
        if current is None:
            path = tuple(name for tag, name, _, _ in stack[:DEEPEST] if tag not in INLINE)
            current = Block(path, [], 0, bool(stack) and stack[-1][2], stack[-1][3] if stack else ())
            found.append(current)
        current.pieces.append(text)
        if links:
            current.linked += len(text)

    at, end = 0, len(page)
    while at < end:
        token = _TOKEN.search(page, at)
        if token is None:
            add(page[at:])
            break
        add(page[at : token.start()])
        at = token.end()
        tag = token.group(2)
        if tag is None or not token.group(4):
            continue
        tag = tag.lower()
        if tag not in INLINE and tag not in RAW:
            current = None
        if token.group(1):
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    if any(t not in INLINE for t, *_ in stack[depth + 1 :]):
                        # An inline end tag cannot close a block that was opened inside it.
                        if tag in INLINE:
                            links -= tag == "a"
                            stack[depth] = ("span", "span", *stack[depth][2:])
                            break
                    links -= sum(t == "a" for t, *_ in stack[depth:])
                    del stack[depth:]
                    break
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in VOID:
            continue
        if tag in ENDS_PARAGRAPH and any(t == "p" for t, *_ in stack):
            depth = max(i for i, (t, *_) in enumerate(stack) if t == "p")
            if all(t in INLINE for t, *_ in stack[depth + 1 :]):
                links -= sum(t == "a" for t, *_ in stack[depth:])
                del stack[depth:]
        elif tag == "li" and stack and any(t == "li" for t, *_ in stack):
            depth = max(i for i, (t, *_) in enumerate(stack) if t == "li")
            if not any(t in ("ul", "ol") for t, *_ in stack[depth + 1 :]):
                del stack[depth:]
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        said, label = _said(token.group(3)) if token.group(3) else (False, "")
        parent = stack[-1] if stack else ("", "", False, ())
        inside_article = bool(parent[3])
        if tag in ("html", "body") or tag in CONTAINERS and not parent[2]:
            said = False
        if tag in HEADINGS and inside_article:
            said = False
        header = tag == "header" and not inside_article
        # The header of an article gives its headings only; that of a page gives nothing.
        aside = parent[2] or said or header or tag in NEVER
        if tag in HEADINGS and inside_article and stack[-1][0] == "header" and not said:
            aside = any(a for t, _, a, _ in stack if t != "header")
        elif tag == "header" and inside_article:
            aside = True
        container = parent[3]
        if tag in CONTAINERS:
            containers += 1
            container = (*container, containers)[:DEEPEST]
        if tag == "a":
            links += 1
        stack.append((tag, tag + label, aside, container))
    return found


def path_scores(blocks: list[tuple[Block, str]], config: PathConfig) -> dict[tuple[str, ...], float]:
    """The fused score of every path.

    The weight of one path for another depends only on their lengths and on how many leading
    names they share, so paths are summed per prefix and length once, and each path meets the
    sums along its own way down instead of every other path.
    """
    length, marks, count = defaultdict(float), defaultdict(float), defaultdict(int)
    for block, text in blocks:
        linked = min(1.0, block.linked / max(len(text), 1))
        length[block.path] += len(text) * (1 - linked)
        marks[block.path] += len(_PUNCTUATION.findall(text)) * (1 - linked)
        count[block.path] += 1
    below: dict[tuple[str, ...], dict[int, list[float]]] = defaultdict(lambda: defaultdict(lambda: [0.0, 0.0, 0.0]))
    for p, n in count.items():
        for k in range(len(p) + 1):
            sums = below[p[:k]][len(p)]
            for i, x in enumerate((1.0, length[p] / n, (1 + marks[p]) / n)):
                sums[i] += x
    scores = {}
    for p in count:
        total = by_length = by_marks = 0.0
        deeper: dict[int, list[float]] = {}
        for k in range(len(p), -1, -1):
            here = below[p[:k]]
            for size, sums in here.items():
                away = (1 - (2 * k / (len(p) + size) if len(p) + size else 1.0)) / config.sigma
                if away < 4:
                    w = math.exp(-0.5 * away * away)
                    less = deeper.get(size, (0.0, 0.0, 0.0))
                    total += w * (sums[0] - less[0])
                    by_length += w * (sums[1] - less[1])
                    by_marks += w * (sums[2] - less[2])
            deeper = here
        scores[p] = math.sqrt(max(by_length, 0.0) / total * (max(by_marks, 0.0) / total))
    return scores


def main_text(page: str | None, config: PathConfig = PathConfig()) -> str:
    """The text of the content blocks, joined by a blank line."""
    if not page:
        return ""
    blocks = [(b, b.text()) for b in blocks_of(page) if not b.aside]
    blocks = [(b, t) for b, t in blocks if t]
    if not blocks:
        return ""
    scores = path_scores(blocks, config)
    best = max(scores.values())
    chosen = {p for p, s in scores.items() if s >= config.threshold * best}
    # Paths that hold more text in links than outside are lists of links, wherever they lie.
    plain = defaultdict(float)
    for b, t in blocks:
        plain[b.path] += len(t) - 2 * min(b.linked, len(t))
    wordy = {p for p in scores if plain[p] >= 0}
    chosen = chosen & wordy or chosen
    # An article or main with chosen text lifts the other paths in it, in its parts and around it.
    homes = {c for b, _ in blocks if b.path in chosen for c in b.containers}
    top = max(chosen, key=lambda p: (scores[p], p))
    parent = top[:-1]
    wide = not homes and len(parent) > 2

    def lifted(b: Block) -> bool:
        return b.path in wordy and (not homes.isdisjoint(b.containers) or wide and b.path[: len(parent)] == parent)

    kept = [t for b, t in blocks if b.path in chosen or lifted(b)]
    return "\n\n".join(kept)


def extract(pages: DataFrame, config: PathConfig = PathConfig(), carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns by default) with main_text, from the column ``html``."""
    carry = [c for c in (carry or pages.columns) if c != "main_text"]
    schema = T.StructType([pages.schema[c] for c in carry]).add("main_text", "string")
    given = pages.select(*[f"`{c}`" for c in carry], pages["html"].alias("__html"))

    def extracted(batches):
        for batch in batches:
            texts = [main_text(p.as_py(), config) for p in batch.column(batch.num_columns - 1)]
            arrays = [*batch.columns[:-1], pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*carry, "main_text"])

    return given.mapInArrow(extracted, schema)
