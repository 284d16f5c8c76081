"""Main text of web pages: gradient-boosted trees over DOM nodes and a hierarchical decoding.

A page becomes a tree of elements and text runs. Every node gets features: its tag, depth, the text
and link density of its subtree, what the attribute tokens of the node and of its ancestors speak for,
and its place and share among its siblings. Boosted trees turn them into log-odds that the node
belongs to, or holds, the main text. The decoder then keeps the set of nodes with the greatest sum of
log-odds in which a kept node's parent is kept as well, so that no descendant can contradict an
ancestor.

There are no labelled pages, so training marks nodes of a bounded sample by their markup (article or
main against menus, footers and so on) and learns from copies of these pages in which the telling
tags are renamed and further boilerplate is put in, so that the trees use more than tag names.
Pages are parsed where they are read; nothing is shuffled.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Facts of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
NEVER_MAIN = frozenset("nav footer aside form menu dialog".split())
SILENT = frozenset("script style template noscript head title textarea select option button svg math iframe object".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav "
    "ol p pre section table ul".split()
)
SAME_CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}

# Markup that marks training nodes.
MAIN_TAGS = frozenset(("article", "main"))
OTHER_TAGS = frozenset("nav header footer aside form menu dialog".split()) | SILENT
MAIN_TOKENS = frozenset("article articlebody content post entry story main body text".split())
OTHER_TOKENS = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo promotion nav navigation navbar menu breadcrumb "
    "breadcrumbs header masthead footer sidebar aside widget related recommended share sharing social comment comments "
    "disqus replies respond notice cookie cookies consent gdpr alert popup modal newsletter subscribe signup login search "
    "form copyright legal pagination pager toolbar skip".split()
)
MADE_TOKENS = ("content", "post", "entry", "story", "text", "page", "main", "")
SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: tuple[str, ...] = ()
    text: str = ""
    children: list[int] = field(default_factory=list)


class TreeBuilder(HTMLParser):
    """Elements and text runs in page order; closes what the page leaves open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#page", -1, 0)]
        self.open = [0]

    def _add(self, tag: str, tokens: tuple[str, ...] = (), text: str = "") -> int:
        parent = self.open[-1]
        self.nodes.append(Node(tag, parent, self.nodes[parent].depth + 1, tokens, text))
        self.nodes[parent].children.append(len(self.nodes) - 1)
        return len(self.nodes) - 1

    def _close_back_to(self, tag: str, stops: Sequence[str] = ()) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            name = self.nodes[self.open[at]].tag
            if name == tag:
                del self.open[at:]
                return
            if name in stops:
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close_back_to("p", ("article", "section", "div", "td", "li", "body", "button"))
        if tag in SAME_CLOSES:
            self._close_back_to(tag, SAME_CLOSES[tag])
        if tag == "body":
            self._close_back_to("head")
        words = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "itemprop", "aria-label"))
        tokens = tuple(t for t in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", words).lower()) if t)
        node = self._add(tag, tokens)
        if tag not in VOID and len(self.open) < 400:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.nodes[self.open[-1]].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        if tag not in VOID:
            self._close_back_to(tag)

    def handle_data(self, data):
        last = self.nodes[-1]
        if last.tag == "#text" and last.parent == self.open[-1]:
            last.text += data
        else:
            self._add("#text", (), data)


def parse(html: str) -> list[Node]:
    """The nodes of a page in page order; node 0 is the page itself."""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return builder.nodes


TAG_KINDS = {
    **dict.fromkeys(("p", "blockquote", "pre"), 1),
    **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), 2),
    **dict.fromkeys(("ul", "ol", "dl", "li", "dt", "dd", "menu"), 3),
    **dict.fromkeys(("div", "section"), 4),
    **dict.fromkeys(("article", "main"), 5),
    **dict.fromkeys(("nav", "header", "footer", "aside", "form", "dialog"), 6),
    **dict.fromkeys(("html", "body", "#page"), 7),
    **dict.fromkeys(SILENT, 8),
    "a": 9,
    "#text": 10,
}


def features_of(nodes: Sequence[Node], token_weight: dict[str, float]) -> np.ndarray:
    """One row a node."""
    n = len(nodes)
    chars, links, runs, paragraphs, tags = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    silent, place = [False] * n, [0] * n
    for i, node in enumerate(nodes):
        silent[i] = node.tag in SILENT or (i > 0 and silent[node.parent])
        if node.tag == "#text":
            chars[i] = 0.0 if silent[i] else float(len(node.text.strip()))
            runs[i] = float(chars[i] > 0)
        else:
            tags[i] = 1.0
            paragraphs[i] = float(node.tag == "p")
            for k, child in enumerate(node.children):
                place[child] = k
    own = chars.copy()
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = nodes[i].parent
        if nodes[i].tag == "a":
            links[i] = chars[i]
        chars[p] += chars[i]
        links[p] += links[i]
        runs[p] += runs[i]
        paragraphs[p] += paragraphs[i]
        tags[p] += tags[i]
    best, worst, semantic = [0.0] * n, [0.0] * n, [0] * n
    total, rows = max(chars[0], 1.0), []
    for i, node in enumerate(nodes):
        p = max(node.parent, 0)
        own_best = own_worst = 0.0
        if node.tokens:
            weights = [token_weight.get(t, 0.0) for t in node.tokens]
            own_best, own_worst = max(max(weights), 0.0), min(min(weights), 0.0)
        best[i], worst[i] = max(own_best, best[p]), min(own_worst, worst[p])
        kind = TAG_KINDS.get(node.tag, 0)
        semantic[i] = semantic[p] or (1 if kind == 5 else -1 if kind in (6, 8) else 0)
        siblings = max(len(nodes[p].children), 1)
        around, inside = max(chars[p], 1.0), max(tags[i], 1.0)
        rows.append(
            (
                kind,
                TAG_KINDS.get(nodes[p].tag, 0),
                node.depth,
                math.log1p(chars[i]),
                chars[i] / total,
                links[i] / max(chars[i], 1.0),
                runs[i] / inside,
                chars[i] / inside,
                math.log1p(paragraphs[i]),
                own_best,
                own_worst,
                best[i],
                worst[i],
                semantic[i],
                siblings,
                place[i] / siblings,
                chars[i] / around,
                links[p] / around,
                math.log1p(own[i]),
                silent[i],
            )
        )
    return np.array(rows, float)


def marks_of(nodes: Sequence[Node]) -> np.ndarray:
    """1 for nodes that belong to or hold the main text, 0 for others, by their markup."""
    inside, other = np.zeros(len(nodes), bool), np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes):
        p = node.parent
        telling = set(node.tokens)
        other[i] = node.tag in OTHER_TAGS or bool(telling & OTHER_TOKENS) or (p >= 0 and other[p])
        main = node.tag in MAIN_TAGS or "articlebody" in "".join(node.tokens) or "main" in telling
        inside[i] = not other[i] and (main or (p >= 0 and inside[p]))
    for i in range(len(nodes) - 1, 0, -1):
        if inside[i]:
            inside[nodes[i].parent] = True
    return inside.astype(int)


def varied(nodes: Sequence[Node], chance: random.Random, texts: Sequence[str]) -> tuple[list[Node], np.ndarray]:
    """A copy with renamed main elements and further boilerplate, and its marks."""
    made: list[Node] = []
    marks: list[int] = []
    known = marks_of(nodes)
    renamed = {tag: chance.choice(("div", "section", "div", tag)) for tag in MAIN_TAGS}
    token = chance.choice(MADE_TOKENS)

    def add(tag: str, parent: int, tokens: tuple[str, ...], text: str, mark: int) -> int:
        made.append(Node(tag, parent, made[parent].depth + 1 if parent >= 0 else 0, tokens, text))
        marks.append(mark)
        if parent >= 0:
            made[parent].children.append(len(made) - 1)
        return len(made) - 1

    def boilerplate(parent: int) -> None:
        words = (chance.choice(sorted(OTHER_TOKENS)),)
        tag = chance.choice(("div", "section", "div", "ul", "aside", "form"))
        block = add(tag, parent, () if tag in ("aside", "form") else words, "", 0)
        for _ in range(chance.randint(1, 4)):
            inner = add(chance.choice(("p", "li", "div", "a")), block, (), "", 0)
            add("#text", inner, (), chance.choice(texts) if texts else "more", 0)

    def copy(i: int, parent: int) -> None:
        node = nodes[i]
        here = add(renamed.get(node.tag, node.tag), parent, (token,) if node.tag in MAIN_TAGS and token else node.tokens, node.text, int(known[i]))
        spots = {chance.randrange(len(node.children) + 1)} if node.tag in ("body", *MAIN_TAGS) and chance.random() < 0.7 else set()
        for k, child in enumerate(node.children):
            if k in spots:
                boilerplate(here)
            copy(child, here)
        if len(node.children) in spots:
            boilerplate(here)

    copy(0, -1)
    return made, np.array(marks)


@dataclass
class Forest:
    """Boosted regression trees: per tree and node the feature, the bound, and the value of leaves."""

    features: list[np.ndarray]
    bounds: list[np.ndarray]
    values: list[np.ndarray]
    base: float
    depth: int

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.base)
        index = np.arange(len(rows))
        for feature, bound, value in zip(self.features, self.bounds, self.values):
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (rows[index, feature[at]] > bound[at])
            out += value[at]
        return out


def boost(rows: np.ndarray, marks: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 24) -> Forest:
    """Newton boosting of the logistic loss with histograms; trees are full, a node without gain sends all left."""
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins)[1:-1])) if len(rows) else np.zeros(1) for f in range(rows.shape[1])]
    coded = np.stack([np.searchsorted(c, rows[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    share = min(max(float(marks.mean()) if len(marks) else 0.5, 1e-3), 1 - 1e-3)
    forest = Forest([], [], [], float(np.log(share / (1 - share))), depth)
    z = np.full(len(rows), forest.base)
    inner, size = 2**depth - 1, 2 ** (depth + 1) - 1
    for _ in range(trees):
        q = 1 / (1 + np.exp(-z))
        slope, curve = q - marks, np.maximum(q * (1 - q), 1e-6)
        feature, bound, value = np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(size)
        at = np.zeros(len(rows), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = at - first
            gains = np.full(count, 1e-6)
            for f, c in enumerate(cuts):
                width = len(c) + 1
                key = local * width + coded[:, f]
                g = np.bincount(key, slope, count * width).reshape(count, width)
                h = np.bincount(key, curve, count * width).reshape(count, width)
                gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                gs, hs = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                if not gain.shape[1]:
                    continue
                best = gain.argmax(1)
                for j in np.flatnonzero(gain[np.arange(count), best] > gains):
                    gains[j] = gain[j, best[j]]
                    feature[first + j], bound[first + j] = f, c[best[j]]
            at = 2 * at + 1 + (rows[np.arange(len(rows)), feature[at]] > bound[at])
        leaf = at - inner
        g, h = np.bincount(leaf, slope, 2**depth), np.bincount(leaf, curve, 2**depth)
        value[inner:] = -rate * g / (h + 1)
        z += value[at]
        forest.features.append(feature)
        forest.bounds.append(bound)
        forest.values.append(value)
    return forest


@dataclass
class Extractor:
    forest: Forest
    token_weight: dict[str, float]


def decode(nodes: Sequence[Node], log_odds: np.ndarray) -> np.ndarray:
    """The kept nodes: the parent-closed set with the greatest sum of log-odds; ties are not kept."""
    best = log_odds.copy()
    for i in range(len(nodes) - 1, 0, -1):
        if nodes[i].tag in SILENT or nodes[i].tag in NEVER_MAIN:
            best[i] = -1.0
        if best[i] > 0:
            best[nodes[i].parent] += best[i]
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and best[i] > 0
    return kept


def blocks_of(nodes: Sequence[Node], kept: np.ndarray) -> list[str]:
    """Kept text by block: inline elements go on with a block, all others begin a new one."""
    blocks: list[str] = []
    parts: list[str] = []

    def end() -> None:
        text = SPACE.sub(" ", "".join(parts)).strip()
        if text:
            blocks.append(text)
        parts.clear()

    stack = [(0, False)]
    while stack:
        i, leaving = stack.pop()
        node = nodes[i]
        if node.tag == "#text":
            parts.append(node.text)
            continue
        if node.tag not in INLINE:
            end()
        if leaving:
            continue
        stack.append((i, True))
        stack.extend((c, False) for c in reversed(node.children) if kept[c])
    end()
    return blocks


def main_blocks(pages: Sequence[str], extractor: Extractor) -> list[list[str]]:
    """The kept blocks of each page; the trees run once over the nodes of all pages."""
    trees = [parse(html) for html in pages]
    log_odds = extractor.forest.log_odds(np.concatenate([features_of(t, extractor.token_weight) for t in trees]))
    out, at = [], 0
    for nodes in trees:
        out.append(blocks_of(nodes, decode(nodes, log_odds[at : at + len(nodes)])))
        at += len(nodes)
    return out


def sample_pages(pages: DataFrame, count: int, longest: int, html_column: str) -> list[str]:
    """At most ``count`` different pages of at most ``longest`` characters, smallest hashes first.

    Hashes are ranked alone, then the chosen pages are read, so tasks send hashes and not pages.
    """
    html = F.col(f"`{html_column}`")
    usable = pages.where(html.isNotNull() & (F.length(html) <= longest)).select(F.xxhash64(html).alias("order"), html.alias("html"))
    chosen = [r["order"] for r in usable.select("order").distinct().orderBy("order").limit(count).collect()]
    rows = usable.where(F.col("order").isin(chosen)).groupBy("order").agg(F.min("html").alias("html"))
    return sorted(r["html"] for r in rows.collect())


def train(pages: DataFrame, count: int = 200, longest: int = 40_000, html_column: str = "html", seed: int = 11) -> Extractor:
    """Fit on a bounded sample; without any page, on one made-up page alone."""
    samples = sample_pages(pages, count, longest, html_column)
    samples.append("<html><head><title>t</title></head><body><nav><a>m</a></nav><article><h1>h</h1><p>text</p></article><footer>f</footer></body></html>")
    chance = random.Random(seed)
    trees = [parse(html) for html in samples]
    texts = sorted({n.text.strip()[:300] for nodes in trees for n in nodes if n.tag == "#text" and n.text.strip()})
    chance.shuffle(texts)
    marked = [(nodes, marks_of(nodes)) for nodes in trees]
    marked += [varied(nodes, chance, texts[:500]) for nodes in trees for _ in range(3)]
    seen: dict[str, list[int]] = {}
    for nodes, marks in marked:
        for node, mark in zip(nodes, marks):
            for t in set(node.tokens):
                seen.setdefault(t, [0, 0])[mark] += 1
    token_weight = {t: float(np.log((b + 1) / (a + 1))) for t, (a, b) in seen.items() if a + b >= 3}
    token_weight |= {t: -2.0 for t in OTHER_TOKENS if t not in token_weight}
    token_weight |= {t: 1.0 for t in MAIN_TOKENS if t not in token_weight and t not in OTHER_TOKENS}
    rows = np.concatenate([features_of(nodes, token_weight) for nodes, _ in marked])
    return Extractor(boost(rows, np.concatenate([m for _, m in marked])), token_weight)


def extract(
    pages: DataFrame, extractor: Extractor, html_column: str = "html", kept: Sequence[str] = ("page_id", "url")
) -> DataFrame:
    """The ``kept`` columns with text (blocks joined by spaces), n_chars and blocks of the whole page.

    Null and empty pages give an empty text and no blocks; broken markup is closed where HTML closes it;
    elements nested deeper than 400 levels lie side by side at that level. Repeated rows are each done.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for begin in range(0, batch.num_rows, 64):
                blocks = main_blocks([h or "" for h in column.slice(begin, 64).to_pylist()], extractor)
                texts = [" ".join(b) for b in blocks]
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(begin, 64).columns[:-1],
                        pa.array(texts, pa.string()),
                        pa.array(list(map(len, texts)), pa.int64()),
                        pa.array(blocks, pa.list_(pa.string())),
                    ],
                    names=[*kept, "text", "n_chars", "blocks"],
                )

    schema = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept]
    schema += ["text string", "n_chars long", "blocks array<string>"]
    source = pages.select(*[f"`{c}`" for c in kept], pages[html_column].alias("__html"))
    return source.mapInArrow(run, ", ".join(schema))
