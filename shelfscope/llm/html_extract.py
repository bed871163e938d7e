"""Main text of web pages by a tree-structured graphical model.

The elements of a page are the nodes of a tree; each is content or not. A node has a potential from its tag, its class and
id words, its own words and the share of links in it; an edge has a potential for the two labels at its ends. Both are
estimated from labelled pages: those with an article element, in which everything inside the article and outside menus,
forms, adverts and the like is content. Messages are passed from the leaves to the root and back, for all pages of a batch at
once, and text whose element is more likely content than not makes up the result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import texts
from shelfscope.llm.ragged import slices

# Pages that the potentials are fitted on, about: chosen by a hash of the page.
SAMPLE_PAGES = 4000
# How far a feature can move the log odds of a node: one that names a purpose, and one that any part of a page may have.
NAMED_BOUND, PLAIN_BOUND = 7.0, 1.5
# Sightings on labelled pages that weigh as much as the purpose that a feature names.
NAMED_SIGHTINGS = 200
# How much likelier a child is to have the label of its parent than the other, at most: log odds for block and inline children of
# elements that are not content, and of those that are.
EDGE_BOUNDS = ((3.5, 3.5), (6.5, 6.5))

# Elements by purpose, as HTML defines them.
CONTENT_TAGS = frozenset({"article", "main"})
OTHER_TAGS = frozenset({"aside", "button", "dialog", "fieldset", "footer", "form", "head", "header", "menu", "nav", "noscript", "object", "select", "title"})
VOID_TAGS = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
RAW_TAGS = frozenset({"iframe", "math", "noembed", "noframes", "script", "style", "svg", "template", "textarea", "xmp"})
INLINE_TAGS = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSED_BY_BLOCK = "p"
SIBLING_TAGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SIBLING_BOUNDS = frozenset({"ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select", "menu"})
# Words in class, id and role that name something other than the article.
OTHER_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright dialog discussion "
    "disclaimer disqus footer form gdpr header legal login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination "
    "popup promo promoted promotion recommended related replies respond responses search share sharing sidebar signup social sponsor sponsored subscribe "
    "subscription toolbar widget widgets".split()
)

_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
# A tag whose attribute values may hold ">" in quotes, and one that ends at the first ">".
_QUOTED_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass
class Page:
    """Elements in page order: parent, tag, names; and text with its element, None where a line breaks."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#root"])
    names: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    pieces: list[tuple[int, str | None]] = field(default_factory=list)


class _Open:
    """The open elements. No operation looks at more of them than it closes, but for a few that could be siblings."""

    def __init__(self, tags: list[str]):
        self.tags, self.stack, self.count = tags, [0], Counter()
        # For each place of the stack the nearest place at or below it that is no inline element, or that lists stop at.
        self.block, self.listed = [0], [0]

    def push(self, element: int):
        tag, at = self.tags[element], len(self.stack)
        self.stack.append(element)
        self.count[tag] += 1
        self.block.append(self.block[-1] if tag in INLINE_TAGS else at)
        self.listed.append(at if tag in SIBLING_TAGS or tag in SIBLING_BOUNDS else self.listed[-1])

    def cut(self, at: int):
        for element in self.stack[at:]:
            self.count[self.tags[element]] -= 1
        del self.stack[at:], self.block[at:], self.listed[at:]

    def end(self, tag: str):
        """Close the innermost element of this tag and all inside it; an end tag without one is passed over."""
        if self.count[tag]:
            self.cut(next(k for k in range(len(self.stack) - 1, 0, -1) if self.tags[self.stack[k]] == tag))

    def begin_block(self):
        """A block closes the paragraph it stands in, with the inline elements between."""
        at = self.block[-1]
        if self.tags[self.stack[at]] == CLOSED_BY_BLOCK:
            self.cut(at)

    def begin_sibling(self, closes: set[str]):
        """A list item, cell or option closes the one before it in the same list."""
        at = self.listed[-1]
        while at > 0 and (tag := self.tags[self.stack[at]]) not in SIBLING_BOUNDS:
            if tag in closes:
                self.cut(at)
                return
            at = self.listed[at - 1]


def parse(html: str) -> Page:
    """Elements of a page. Unclosed and misplaced tags are taken as browsers take them, as far as text is concerned.

    One forward pass in linear time. Quotes count after an equals sign; from a tag on that they would leave open to the end
    of the page, tags end at their first ">".
    """
    page, size = Page(), len(html)
    tags, opened = page.tag, _Open(page.tag)
    stack, last_end, pattern = opened.stack, html.rfind(">"), _QUOTED_TAG
    at = seek = 0

    def text(piece: str):
        if piece:
            page.pieces.append((stack[-1], unescape(piece) if "&" in piece else piece))

    while at < size:
        start = html.find("<", seek)
        mark = html[start + 1 : start + 2]
        if start < 0 or (start > last_end and not html.startswith("<!--", start)):
            text(html[at:])
            break
        if html.startswith("<!--", start):
            text(html[at:start])
            at = seek = _COMMENT.match(html, start).end()
            continue
        name = html[start + 2 : start + 3] if mark == "/" else mark
        if name not in _LETTERS:
            if mark in ("!", "?", "/"):
                text(html[at:start])
                at = seek = html.index(">", start) + 1
            else:
                seek = start + 1
            continue
        token = pattern.match(html, start)
        if token is None:
            pattern = _PLAIN_TAG
            token = pattern.match(html, start)
        text(html[at:start])
        at = seek = token.end()
        tag, rest = token[2].lower(), token[3]
        if tag not in INLINE_TAGS:
            page.pieces.append((stack[-1], None))
        if token[1]:
            opened.end(tag)
            continue
        if tag in RAW_TAGS:
            if not rest.rstrip().endswith("/") or tag not in {"svg", "math"}:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                after = html.find(">", close.end()) if close else -1
                at = seek = after + 1 or size
            continue
        if tag in VOID_TAGS:
            continue
        if tag not in INLINE_TAGS:
            opened.begin_block()
        if tag in SIBLING_TAGS:
            opened.begin_sibling(SIBLING_TAGS[tag])
        names = ()
        if "=" in rest:
            values = " ".join(a or b or c for a, b, c in _NAMES.findall(rest))
            names = tuple({w.lower() for w in _WORD.findall(values)})
        page.parent.append(stack[-1])
        page.tag.append(tag)
        page.names.append(names)
        opened.push(len(page.parent) - 1)
    return page


def _is_other(tag: str, names: tuple[str, ...]) -> bool:
    return tag in OTHER_TAGS or not OTHER_WORDS.isdisjoint(names)


def labels(page: Page) -> list[bool] | None:
    """Content or not for each element, from what the page itself says; None if it names no article."""
    if CONTENT_TAGS.isdisjoint(page.tag):
        return None
    out, other = [False], [False]
    for parent, tag, names in zip(page.parent[1:], page.tag[1:], page.names[1:], strict=True):
        other.append(other[parent] or (tag not in CONTENT_TAGS and _is_other(tag, names)))
        out.append((out[parent] or tag in CONTENT_TAGS) and not other[-1])
    return out


def aligned(page: Page, text: str) -> list[bool] | None:
    """Content or not for each element, from the page's known main text; None if its pieces do not make up that text.

    Pieces are matched in page order without white space. An element without text of its own is content if most of the
    text inside it is, and as its parent is if there is none.
    """
    left, at = "".join(text.split()), 0
    inside, outside = [0] * len(page.parent), [0] * len(page.parent)
    for element, piece in page.pieces:
        packed = "".join(piece.split()) if piece else ""
        if packed and left.startswith(packed, at):
            at += len(packed)
            inside[element] += len(packed)
        else:
            outside[element] += len(packed)
    if at < len(left):
        return None
    own = [a > b if a + b else None for a, b in zip(inside, outside, strict=True)]
    for i in range(len(page.parent) - 1, 0, -1):
        inside[page.parent[i]] += inside[i]
        outside[page.parent[i]] += outside[i]
    out: list[bool] = []
    for i, known in enumerate(own):
        if known is None:
            known = inside[i] > outside[i] if inside[i] + outside[i] else bool(i) and out[page.parent[i]]
        out.append(known)
    return out


def _bucket(words: int) -> int:
    return min(words.bit_length(), 7)


def features(page: Page) -> list[list[str]]:
    """Features of each element."""
    n = len(page.parent)
    own, linked, total = [0] * n, [0] * n, [0] * n
    for element, piece in page.pieces:
        if piece:
            words = len(piece.split())
            own[element] += words
            if page.tag[element] == "a":
                linked[element] += words
    for i in range(n - 1, -1, -1):
        total[i] += own[i]
        if i:
            total[page.parent[i]] += total[i]
            linked[page.parent[i]] += linked[i]
    out = []
    for i in range(n):
        share = 4 * linked[i] // total[i] if total[i] else 5
        out.append([f"tag={page.tag[i]}", f"words={_bucket(own[i])}", f"links={share}", *[f"name={w}" for w in page.names[i]]])
    return out


def _named(feature: str) -> int:
    """1 for a feature that names an article, -1 for one that names something else, 0 for any other."""
    kind, value = feature.split("=", 1)
    if kind == "tag":
        return (value in CONTENT_TAGS) - (value in OTHER_TAGS)
    return -(value in OTHER_WORDS) if kind == "name" else 0


@dataclass
class Potentials:
    """Log odds of features, log potentials of edges by (kind of child, parent label, child label)."""

    odds: dict[str, float]
    edge: np.ndarray

    def of(self, node_features: list[str]) -> float:
        total = 0.0
        for f in node_features:
            value = self.odds.get(f)
            total += NAMED_BOUND * _named(f) if value is None else value
        return total


def fit(counts: dict[tuple[str, str], int]) -> Potentials:
    """Potentials from counts: (feature, label) and ("edge=<inline><parent label>", child label)."""
    n = [sum(v for (f, y), v in counts.items() if y == label and f.startswith("tag=")) for label in "01"]
    odds = {}
    for f in {f for f, _ in counts if not f.startswith("edge=")}:
        # A feature that names a purpose starts from that; one seen no more often on either side says little.
        a, b = counts.get((f, "1"), 0) + 0.5, counts.get((f, "0"), 0) + 0.5
        value = np.log(a / (n[1] + 1)) - np.log(b / (n[0] + 1))
        named, seen = _named(f), a + b
        if named:
            shown = seen * np.clip(value, -NAMED_BOUND, NAMED_BOUND)
            odds[f] = float((NAMED_SIGHTINGS * NAMED_BOUND * named + shown) / (NAMED_SIGHTINGS + seen))
        else:
            odds[f] = float(np.clip(value, -PLAIN_BOUND, PLAIN_BOUND))
    # Third kind of child: one that names another purpose. It is what it is wherever it stands and says nothing about its parent.
    edge = np.full((3, 2, 2), np.log(0.5))
    for inline in (0, 1):
        for y in (0, 1):
            seen = np.array([counts.get((f"edge={inline}{y}", str(c)), 0) + (30.0 if c == y else 1.0) for c in (0, 1)])
            p = seen / seen.sum()
            bounded = np.clip(np.log(p[y] / p[1 - y]), 1.0, EDGE_BOUNDS[inline][y])
            edge[inline, y, y], edge[inline, y, 1 - y] = -np.log1p(np.exp(-bounded)), -bounded - np.log1p(np.exp(-bounded))
    return Potentials(odds, edge)


def marginals(parent: np.ndarray, kind: np.ndarray, odds: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Probability of content for each node of a forest in which a parent comes before its children (-1: a root)."""
    n = len(parent)
    depth = np.zeros(n, np.int64)
    for i, p in enumerate(parent.tolist()):
        if p >= 0:
            depth[i] = depth[p] + 1
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
    own = np.stack([np.zeros(n), odds], 1)
    up, message = own.copy(), np.zeros((n, 2))
    for level in reversed(levels[1:]):
        # Sum over the child's label of edge potential times all that lies below.
        message[level] = np.logaddexp.reduce(edge[kind[level]] + up[level][:, None, :], axis=2)
        np.add.at(up, parent[level], message[level])
    down = np.zeros((n, 2))
    for level in levels[1:]:
        above = (up + down)[parent[level]] - message[level]
        down[level] = np.logaddexp.reduce(edge[kind[level]] + above[:, :, None], axis=1)
    both = up + down
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))


def extract(pages: list[Page], potentials: Potentials) -> list[str]:
    """Main text of each page."""
    first = np.append(0, np.cumsum([len(p.parent) for p in pages]))
    parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + f) for p, f in zip(pages, first, strict=False)]) if pages else np.zeros(0, np.int64)
    kind = np.array([2 if _is_other(t, n) and t not in CONTENT_TAGS else int(t in INLINE_TAGS) for p in pages for t, n in zip(p.tag, p.names, strict=True)], np.int64)
    odds = np.array([potentials.of(f) for p in pages for f in features(p)])
    content = marginals(parent, kind, odds, potentials.edge) > 0.5 if pages else odds
    out = []
    for page, (a, _) in zip(pages, pairwise(first), strict=True):
        keep = content[a:]
        out.append(" ".join("".join(" " if piece is None else piece for element, piece in page.pieces if keep[element]).split()))
    return out


def fitted(rows: DataFrame, sample: int, labelled: DataFrame | None = None) -> Potentials:
    """Potentials from about ``sample`` pages; what comes to the driver is one number for each feature and label.

    Pages with a known ``__truth`` (``labelled``) are counted beside those that name their article themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        counts: dict[tuple[str, str], int] = {}
        for batch in batches:
            for html, truth in zip(batch.column("__text").to_pylist(), batch.column("__truth").to_pylist(), strict=True):
                page = parse(html)
                known = labels(page) if truth is None else aligned(page, truth)
                if known is None:
                    continue
                for i, own in enumerate(features(page)):
                    y = str(int(known[i]))
                    edge = [f"edge={int(page.tag[i] in INLINE_TAGS)}{int(known[page.parent[i]])}"] if i else []
                    for f in [*own, *edge]:
                        # Class and id words are unbounded; only those with a meaning known beforehand are counted.
                        if not f.startswith("name=") or _named(f):
                            counts[f, y] = counts.get((f, y), 0) + 1
        # Names of made-up elements are unbounded too: those above 15 letters, more than any of HTML, have no potential of their own.
        keys = [k for k in counts if not k[0].startswith("tag=") or len(k[0]) < 20]
        yield pa.record_batch({"feature": pa.array([k[0] for k in keys], pa.string()), "label": pa.array([k[1] for k in keys], pa.string()), "n": pa.array([counts[k] for k in keys], pa.int64())})

    def picked(pages: DataFrame, truth):
        part = min(1.0, sample / max(pages.count(), 1)) * (1 << 30)
        return pages.filter(F.pmod(F.xxhash64("__text"), F.lit(1 << 30)) < part).select("__text", truth.alias("__truth"))

    seen = picked(rows, F.lit(None).cast("string"))
    if labelled is not None:
        seen = seen.unionByName(picked(labelled, F.coalesce("__truth", F.lit(""))))
    seen = seen.mapInArrow(run, "feature string, label string, n long")
    return fit({(r["feature"], r["label"]): r["n"] for r in seen.groupBy("feature", "label").agg(F.sum("n").alias("n")).collect()})


def main_text(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", sample: int = SAMPLE_PAGES, labelled: DataFrame | None = None) -> DataFrame:
    """One row for each row of ``pages``: ``__id``, ``url`` (if there is one), ``text`` and ``n_chars``, its code points.

    Character references are decoded, white space inside a block becomes one blank, blocks follow each other in page
    order with one blank between them. Null and empty pages, and pages without content, give an empty text. Repeated rows are
    extracted each; an empty table gives no rows; other columns are not read. A page whose labels are equally likely is not
    content. Without labelled pages the potentials are those that tags and class words have by their meaning.

    ``labelled`` holds pages whose main text is known, in ``html_column`` and ``text``, for sites that use names in their own
    way: what they show weighs against the meaning of a name by its sightings. At most about ``sample`` of them are taken. A
    page whose pieces do not make up its text teaches nothing; a null text is an empty one.
    """
    url = pages["url"] if "url" in pages.columns else F.lit(None).cast("string")
    rows = texts(pages, id_column, html_column, url=url)
    taught = None if labelled is None else texts(labelled, labelled.columns[0], html_column, __truth=labelled["text"])
    potentials = fitted(rows, sample, taught)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, "__text", 1 << 20):
                found = extract([parse(h) for h in part.column("__text").to_pylist()], potentials)
                yield pa.record_batch({"__id": part.column("__id"), "url": part.column("url"), "text": pa.array(found, pa.string()), "n_chars": pa.array([len(t) for t in found], pa.int64())})

    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(run, f"__id {kind}, url string, text string, n_chars long")
