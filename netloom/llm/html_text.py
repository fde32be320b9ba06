"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text at block-level tags. A linear classifier over a block's surroundings
(elements, class and id words, roles), length and links gives the gain of calling it content; these gains are
the terminal capacities. Smoothness edges join neighbouring blocks, the more the closer they are in the
document tree, and successive blocks of one parent. The minimum cut separates content from boilerplate.

Defined results: NULL and empty pages give empty text; unclosed comments, scripts and tags end with the page;
a self-closed svg is empty; a "<" that begins no tag is text; NULL identifiers and repeated rows are kept as they
are; an empty table gives an empty result; other columns play no part. Each page is taken whole, in one task; pages are not shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm import common
from netloom.llm.mincut import label

# After a tag's name. A quotation mark opens a value only behind an equals sign; one that is never closed is part of a name.
_ATTRIBUTES = r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]++)?+)?+)*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<svg(?=[\s/>]){_ATTRIBUTES}(?<=/)>"
    rf"|<(script|style|textarea|title|noscript|iframe|template|svg|select)(?=[\s/>]){_ATTRIBUTES}(?:>.*?(?:</\1(?=[\s/>])[^>]*+>|\Z)|\Z)"
    rf"|</?[a-z][^\s/>]*+{_ATTRIBUTES}(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*')")
_NAME = re.compile(r"</?([a-z][^\s/>]*)", re.I)
_ATTRIBUTE = re.compile(r"([a-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HINT = re.compile(r"[a-z]+")
_NOT_IT = re.compile(r"\b(?:no|with|without|has)[-_][a-z]+", re.I)  # "no-sidebar" is no sidebar
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody
    td tfoot th thead tr ul""".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# A new one of these ends an open one of the same set, up to the nearest element named after it.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
         "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

# Gains by element, and by words of class, id and role. Sums run down the tree.
_ELEMENT_GAIN = {"nav": -8, "footer": -8, "aside": -8, "form": -8, "button": -8, "dialog": -8, "menu": -8, "search": -8, "fieldset": -8, "head": -20,
                 "article": 4, "main": 3}
_WORSE = frozenset("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner
    cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup signin login popup modal overlay
    sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar share sharing social
    related recommended recommendations comment comments commentlist reply replies respond disqus discussion copyright legal disclaimer pager
    pagination skip complementary contentinfo search dialog outbrain taboola tags toc hidden""".split())
_BETTER = frozenset("article content entry main post story text body".split())
_TAG_GAIN = {"p": 1.5, "h1": 1.0, "h2": 0.8, "h3": 0.8, "h4": 0.5, "h5": 0.5, "h6": 0.5, "blockquote": 1.5, "pre": 1.5, "li": 0.1, "td": 0.1, "th": 0.1}


class _Node:
    __slots__ = ("tag", "parent", "depth", "gain", "inside", "link", "block")

    def __init__(self, tag, parent, depth, gain, inside, link):
        self.tag, self.parent, self.depth, self.gain, self.inside, self.link = tag, parent, depth, gain, inside, link
        self.block = self if parent is None or tag in BLOCK else parent.block  # the nearest block-level element, this one included


def _open(tag: str, source: str, parent: _Node) -> _Node:
    gain, inside = _ELEMENT_GAIN.get(tag, 0.0), parent.inside or tag in ("article", "main")
    if tag == "header" and not parent.inside:
        gain -= 8
    if "=" in source or " hidden" in source:
        words: set[str] = set()
        for name, a, b, c in _ATTRIBUTE.findall(source):
            name, value = name.lower(), a or b or c
            if name in ("class", "id", "role"):
                words.update(_HINT.findall(_CAMEL.sub(" ", _NOT_IT.sub(" ", value)).lower()))
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) or name == "aria-hidden" and value == "true":
                words.add("hidden")
        if re.search(r"\shidden[\s/>]", _QUOTED.sub("= ", source)):
            words.add("hidden")
        if tag not in ("html", "body"):  # words there describe the whole page
            if words & _WORSE:
                gain -= 8
            elif words & _BETTER or tag == "div" and "header" not in words and words & {"page", "primary"}:
                gain += 1.5
            if "header" in words and not parent.inside:
                gain -= 8
    return _Node(tag, parent, parent.depth + 1, parent.gain + gain, inside, parent.link or tag == "a")


class Block:
    """Text between block-level tags: its parts, its element and how much of it is link text."""

    __slots__ = ("parts", "node", "linked")

    def __init__(self, node: _Node):
        self.parts, self.node, self.linked = [], node, 0


def blocks_of(page: str) -> list[tuple[str, _Node, float]]:
    """(text, element, share of link text) of each block in page order."""
    root = _Node("", None, 0, 0.0, False, False)
    node, found, block = root, [], Block(root)
    is_open: dict[str, int] = {}  # open elements by name, so that a stray end tag needs no walk

    def text(piece: str):
        if piece:
            block.parts.append(piece)
            if node.link:
                block.linked += len(piece)

    def close(now: _Node):
        nonlocal block
        if block.parts:
            found.append(block)
        block = Block(now.block)

    def leave(outer: _Node):
        """Ends the open elements below ``outer``."""
        nonlocal node
        while node is not outer:
            is_open[node.tag] -= 1
            node = node.parent

    at = 0
    for token in _TOKEN.finditer(page):
        text(page[at : token.start()])
        at = token.end()
        source = token[0]
        if source[1] in "!?" or token[1]:
            if (token[1] or "").lower() in ("select", "textarea"):
                text(" ")
            continue
        tag = _NAME.match(source)[1].lower()
        if source[1] == "/":
            if is_open.get(tag):
                up = node
                while up.tag != tag:
                    up = up.parent
                leave(up.parent)
            if tag in BLOCK:
                close(node)
            continue
        if tag == "br":
            text("\n")
        if tag in BLOCK:
            if tag in _ENDS:
                same, border = _ENDS[tag]
                up = node if any(map(is_open.get, same)) else root
                while up.tag and up.tag not in same and up.tag not in border:
                    up = up.parent
                if up.tag in same:
                    leave(up.parent)
            if node.block.tag == "p":  # an open paragraph ends, and what is open in it
                leave(node.block.parent)
        if tag not in _VOID:
            inner = _open(tag, source, node)
            if tag in BLOCK or not source.endswith("/>"):
                node = inner
                is_open[tag] = is_open.get(tag, 0) + 1
        if tag in BLOCK:
            close(node)
    text(page[at:])
    close(root)
    out = []
    for b in found:
        content = " ".join(html.unescape("".join(b.parts)).split())
        if content:
            out.append((content, b.node, min(1.0, b.linked / len(content))))
    return out


def gain_of(content: str, node: _Node, links: float) -> float:
    """How much better a block is as content than as boilerplate; a linear classifier with fixed weights."""
    words = content.count(" ") + 1
    gain = node.gain + _TAG_GAIN.get(node.tag, 0.0) + min(words, 40) / 12 - (1.0 if node.inside else 4.0) * links - 0.6
    if "©" in content and words < 30 or words < 40 and not node.inside and re.search(r"\b(?:cookies?|all rights reserved|copyright)\b", content, re.I):
        gain -= 2.0
    return gain


def _apart(a: _Node, b: _Node) -> int:
    """Steps between two elements of the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def main_text(page: str) -> str:
    """Content blocks, joined by an empty line."""
    blocks = blocks_of(page)
    edges: dict[tuple[int, int], float] = {}
    last_of: dict[int, int] = {}
    for i, (_, node, _) in enumerate(blocks):
        if i:
            edges[i - 1, i] = 2.0 / (1 + _apart(blocks[i - 1][1], node))
        parent = id(node.parent or node)
        if parent in last_of:
            pair = (last_of[parent], i)
            edges[pair] = edges.get(pair, 0.0) + 0.6
        last_of[parent] = i
    content = label([gain_of(*b) for b in blocks], edges)
    return "\n\n".join(b[0] for b, kept in zip(blocks, content, strict=True) if kept)


def extract(pages: DataFrame, page: str = "html", ident: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    common.tune(pages.sparkSession)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py() or "") for p in batch.column("page")]
            yield pa.RecordBatch.from_pydict(
                {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    rows = pages.select(F.col(ident).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("page"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
