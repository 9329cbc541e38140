"""Main text of web pages: boosted trees over the nodes of the page, decoded along the tree.

Every element gets features of its own (tag, attribute tokens, depth), of its subtree (text, links, punctuation), of its
siblings and of what stands above it. Gradient-boosted trees give the chance that it belongs to the article. Decoding then finds
the best labelling in which a node is outside the article, in it, or cut out of it, where below outside only outside or in may
follow, below in only in or cut, and below cut only cut: no menu can hold article text that an ancestor has given up.

The trees are fitted on the elements of at most ``FIT_PAGES`` pages, those with the smallest id hash, labelled by what page
markup says outright: ``article`` and ``main`` elements, roles and well-known class names. Half of these examples have markup
features blanked, so that density decides where markup says nothing. Everything else runs over all pages in place, without a shuffle.

Null and empty pages give empty text. Unclosed and stray tags are tolerated. Repeated rows are treated alike. An empty table gives
an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import bounded_batches, chunks, received, shared_value

FIT_PAGES, EXAMPLES, SEED = 400, 300, 3
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 40, 4, 0.3, 32, 20
#: Cost of each change from outside into the article or from the article into a cut, against log odds.
ENTER_COST, CUT_COST = 3.0, 0.5

PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label|hidden|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset((
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option select").split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag closes an open one of these, up to the boundary.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
#: What markup says outright.
ARTICLE_TAGS = frozenset("article main".split())
OTHER_TAGS = frozenset("nav footer aside form button select head dialog menu input label fieldset".split())
ARTICLE_TOKENS = frozenset("article articlebody main content post entry story body text hentry blog page".split())
OTHER_TOKENS = frozenset((
    "ad ads advert adverts advertisement adbox banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer "
    "sidebar aside widget related recommended share sharing social comment comments respond reply replies disqus cookie cookies consent notice "
    "notices alert popup modal newsletter subscribe subscription signup login search form pagination pager masthead toolbar copyright legal "
    "disclaimer tags skip complementary contentinfo hidden").split())
MARKUP = 8  # the first features are read off markup
FEATURES = [
    "article_tag", "other_tag", "article_tokens", "other_tokens", "above_article_tag", "above_other_tag", "above_article_tokens",
    "above_other_tokens", "heading", "paragraph", "list", "inline", "depth", "text", "own_text", "links", "marks", "word_length",
    "children", "siblings", "place_among_siblings", "share_of_parent", "share_of_page", "alike_siblings", "place_in_page", "text_per_node",
    "paragraphs_below", "sibling_text",
]


@dataclass
class Node:
    tag: str
    up: int
    depth: int
    article: int
    other: int
    below: list[int]
    parts: list  # text as str, child elements as int, in order
    at: int
    place: int = 0  # among the elements below ``up``


def parsed(page: str) -> list[Node]:
    """Elements in page order, the first one standing for the page; scripts, styles, comments and the head's title are left out."""
    nodes = [Node("", -1, 0, 0, 0, [], [], 0)]
    stack = [0]
    for found in PIECE.finditer(page):
        closing, tag, rest = found.group(2), found.group(3), found.group(4)
        if tag is None:
            piece = found.group()
            if found.group(1) is None and (piece[0] != "<" or piece == "<"):
                nodes[stack[-1]].parts.append(entities.unescape(piece))
            continue
        tag = tag.lower()
        if closing:
            if any(nodes[i].tag == tag for i in stack[1:]):
                while nodes[stack.pop()].tag != tag:
                    pass
            continue
        if tag in BLOCK:  # a block ends an open paragraph and whatever stands open in it
            for i, k in enumerate(stack):
                if nodes[k].tag == "p":
                    del stack[i:]
                    break
        if tag in CLOSES:
            ends, bounds = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]].tag in bounds:
                    break
                if nodes[stack[i]].tag in ends:
                    del stack[i:]
                    break
        up = stack[-1]
        article = other = 0
        if rest and "=" in rest:
            for name, a, b, c in ATTRIBUTE.findall(rest):
                value = a or b or c
                if name.lower() == "style":
                    other += "display:none" in value.replace(" ", "").lower()
                    continue
                for token in TOKEN.findall(value):
                    token = token.lower()
                    article += token in ARTICLE_TOKENS
                    other += token in OTHER_TOKENS
        here = len(nodes)
        nodes.append(Node(tag, up, len(stack), article, other, [], [], found.start(), len(nodes[up].below)))
        nodes[up].below.append(here)
        nodes[up].parts.append(here)
        if tag not in VOID and not rest.rstrip().endswith("/"):
            stack.append(here)
    return nodes


def features(nodes: list[Node], length: int) -> np.ndarray:
    """A row of ``FEATURES`` per element."""
    n = len(nodes)
    own, links, marks, count, spaces, paragraphs = (np.zeros(n) for _ in range(6))
    above = np.zeros((n, 4))
    for i, node in enumerate(nodes):
        for part in node.parts:
            if part.__class__ is str and (part := part.strip()):
                own[i] += len(part)
                marks[i] += part.count(".") + part.count(",") + part.count(";") + part.count("?") + part.count("!")
                spaces[i] += part.count(" ") + 1
        count[i] = 1
        paragraphs[i] = node.tag == "p"
        if node.tag == "a":
            links[i] = own[i]
        if node.up >= 0:
            up = nodes[node.up]
            above[i] = above[node.up]
            above[i, 0] += up.tag in ARTICLE_TAGS
            above[i, 1] += up.tag in OTHER_TAGS
            above[i, 2] += min(up.article, 1)
            above[i, 3] += min(up.other, 1)
    text = own.copy()
    for i in range(n - 1, 0, -1):
        up = nodes[i].up
        text[up] += text[i]
        links[up] += text[i] if nodes[i].tag == "a" else links[i]
        marks[up] += marks[i]
        count[up] += count[i]
        spaces[up] += spaces[i]
        paragraphs[up] += paragraphs[i]
    out = np.zeros((n, len(FEATURES)), np.float32)
    whole = max(1.0, text[0])
    alike = Counter((node.up, node.tag) for node in nodes)
    for i, node in enumerate(nodes):
        up = nodes[node.up] if node.up >= 0 else node
        siblings = up.below
        t = max(1.0, text[i])
        out[i] = (
            node.tag in ARTICLE_TAGS, node.tag in OTHER_TAGS, min(node.article, 3), min(node.other, 3), *np.minimum(above[i], 3),
            node.tag in HEADING, node.tag == "p", node.tag in ("ul", "ol", "li", "dl", "dd", "dt", "menu"), node.tag not in BLOCK, node.depth,
            np.log1p(text[i]), np.log1p(own[i]), min(1.0, links[i] / t), marks[i] / t, t / max(1.0, spaces[i]), len(node.below), len(siblings),
            node.place / max(1, len(siblings)), text[i] / max(1.0, text[node.up] if node.up >= 0 else whole),
            text[i] / whole, alike[node.up, node.tag] / max(1, len(siblings)), node.at / max(1, length), np.log1p(text[i] / count[i]), np.log1p(paragraphs[i]),
            np.log1p(max(0.0, (text[node.up] if node.up >= 0 else whole) - text[i])))
    return out


def markup_labels(x: np.ndarray) -> np.ndarray:
    """1 in the article, 0 outside, by markup alone."""
    inside = (x[:, 0] + x[:, 4] > 0) | ((x[:, 2] + x[:, 6] > 0) & (x[:, 0] + x[:, 4] == 0))
    out = (x[:, 1] + x[:, 5] > 0) | (x[:, 3] + x[:, 7] > 0)
    return np.where(out, 0, np.where(inside, 1, 0)).astype(np.int8)


class Trees:
    """Gradient-boosted trees for log loss over binned features; every tree is complete, of ``DEPTH`` levels."""

    def __init__(self):
        self.edges, self.start = np.zeros((len(FEATURES), BINS - 1), np.float32), 0.0
        self.feature = np.zeros((0, 2**DEPTH - 1), np.int64)
        self.cut = np.zeros((0, 2**DEPTH - 1), np.int64)
        self.value = np.zeros((0, 2**DEPTH), np.float64)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[f], x[:, f], "left") for f in range(x.shape[1])], axis=1)

    def leaves(self, b: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        at, row = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(DEPTH):
            at = 2 * at + 1 + (b[row, feature[at]] > cut[at])
        return at - (2**DEPTH - 1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        self.edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.astype(np.float32)
        b = self.binned(x)
        mean = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3))
        self.start = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.start)
        trees = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
            feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS, np.int64)
            at = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                first, nodes = 2**level - 1, 2**level
                best = np.full(nodes, 1e-6)
                here = at - first
                for f in range(b.shape[1]):
                    slot = here * BINS + b[:, f]
                    gs, hs, ns = (np.bincount(slot, w, nodes * BINS).reshape(nodes, BINS).cumsum(1) for w in (g, h, np.ones(len(y))))
                    gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(ns < LEAST_LEAF) | (nt - ns < LEAST_LEAF)] = 0
                    k = gain.argmax(axis=1)
                    better = gain[np.arange(nodes), k] > best
                    best = np.where(better, gain[np.arange(nodes), k], best)
                    feature[first:first + nodes][better], cut[first:first + nodes][better] = f, k[better]
                at = 2 * at + 1 + (b[np.arange(len(b)), feature[at]] > cut[at])
            leaf = at - (2**DEPTH - 1)
            value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
            score += value[leaf]
            trees.append((feature, cut, value))
        self.feature, self.cut, self.value = (np.stack(t) for t in zip(*trees))
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b, out = self.binned(x), np.full(len(x), self.start)
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            out += value[self.leaves(b, feature, cut)]
        return out


def trained(pages: list[str]) -> Trees:
    """Trees fitted on the labelled elements of these pages and of ``examples()``; pages whose markup names no article are left out."""
    x, y, rng = [], [], np.random.default_rng(SEED)
    for page in [*pages, *examples()]:
        nodes = parsed(page)
        made = features(nodes, len(page))
        labels = markup_labels(made)
        if labels.any():
            x.append(made)
            y.append(labels)
    xs, ys = np.concatenate(x), np.concatenate(y)
    blank = xs.copy()
    blank[:, :MARKUP] = 0
    # Markup weighs more than density: blanked examples count half, and half of them are left out.
    weight = np.concatenate([np.ones(len(xs)), np.where(rng.random(len(xs)) < 0.5, 0.5, 0.0)])
    return Trees().fit(np.concatenate([xs, blank]), np.concatenate([ys, ys]).astype(float), weight)


def _example(rng: np.random.Generator, lead: str, close: str) -> str:
    """A page with a random choice of the parts that pages have around and inside an article, of any length."""
    def some(part: str, chance: float = 0.5) -> str:
        return part if rng.random() < chance else ""

    def say(most: int) -> str:
        n = int(rng.integers(1, most + 1))
        return " ".join("lorem"[: int(rng.integers(1, 6))] * int(rng.integers(1, 3)) + some(",", 0.1) for _ in range(n)).strip(",").capitalize() + "."

    def prose() -> str:
        out = [say(20) for _ in range(int(rng.integers(1, 6)))]
        out[0] += some(f' <a href="/p">{say(4)}</a> ', 0.3) + some(f" <b>{say(3)}</b> {say(9)}", 0.2)
        return "<p>" + " ".join(out) + "</p>"

    links = "".join(f'<li><a href="/{i}">{say(3)}</a></li>' for i in range(int(rng.integers(1, 9))))
    body = "".join(prose() for _ in range(int(rng.integers(1, 12))))
    article = (
        lead + some(f"<h1>{say(9)}</h1>", 0.8) + some(f'<p class="lead"><b>{say(15)}</b></p>', 0.3) + body + some(f"<ul><li>{say(8)}</li><li>{say(8)}</li></ul>", 0.3)
        + some(f"<h2>{say(5)}</h2>{body}", 0.3) + some(f"<blockquote>{say(12)}</blockquote>", 0.2) + some(f"<aside>{say(9)} <a href='/x'>{say(4)}</a></aside>", 0.3)
        + some(f'<div class="ad">{say(8)}</div>', 0.3) + some(f'<div class="share-buttons"><a href="/s">{say(2)}</a></div>', 0.3) + close)
    page = (
        some(f'<header class="masthead"><a href="/">{say(2)}</a></header>') + some(f"<nav><ul>{links}</ul></nav>") + some(f'<div id="menu"><ul>{links}</ul></div>', 0.3)
        + some(f'<div class="cookie-notice">{say(9)} <a href="/c">{say(2)}</a></div>', 0.3) + some(f'<div class="ad">{say(9)}</div>', 0.4)
        + some(f'<div class="sidebar"><h3>{say(3)}</h3><ul>{links}</ul><p>{say(20)}</p></div>', 0.4) + article
        + some(f'<section class="comments"><h3>{say(2)}</h3><div><p>{say(30)} {say(20)}</p></div><p>{say(20)}</p><form><input name="q"><button>{say(2)}</button></form></section>', 0.4)
        + some(f'<div class="related"><ul>{links}</ul></div>', 0.3) + some(f"<footer><p>{say(9)}</p></footer>", 0.6))
    page = f'<div class="wrap"><div class="row">{page}</div></div>' if rng.random() < 0.3 else page
    return f"<html><body>{page}</body></html>" if rng.random() < 0.8 else page


def examples() -> list[str]:
    """Pages with the parts that markup names, so that every markup feature occurs in the fit whatever the sample holds."""
    rng = np.random.default_rng(SEED)
    around = [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"), ('<div id="main"><div class="entry">', "</div></div>"),
              ('<div role="main">', "</div>"), ("<main><article>", "</article></main>"), ('<section class="story">', "</section>")]
    return [_example(rng, *around[i % len(around)]) for i in range(EXAMPLES)]


def decoded(nodes: list[Node], log_odds: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each element whether it is in the article, by the labelling of least cost."""
    n = len(nodes)
    inside = np.logaddexp(0, -log_odds) * weight
    beyond = np.logaddexp(0, log_odds) * weight
    # Costs of a subtree whose root is outside, in, cut.
    out, in_, cut = beyond.tolist(), inside.tolist(), beyond.tolist()
    for i in range(n - 1, 0, -1):
        up = nodes[i].up
        out[up] += min(out[i], in_[i] + ENTER_COST)
        in_[up] += min(in_[i], cut[i] + CUT_COST)
        cut[up] += cut[i]
    state = [0] * n
    for i in range(1, n):
        above = state[nodes[i].up]
        if above == 0:
            state[i] = 0 if out[i] <= in_[i] + ENTER_COST else 1
        elif above == 1:
            state[i] = 1 if in_[i] <= cut[i] + CUT_COST else 2
        else:
            state[i] = 2
    return np.array(state) == 1


def rendered(nodes: list[Node], chosen: np.ndarray) -> str:
    """Text of the chosen elements: one line per block, in page order."""
    blocks, current = [], []

    def flush():
        line = " ".join("".join(current).split())
        if line:
            blocks.append(line)
        current.clear()

    # Depth first without recursion, as pages may nest deeply.
    todo: list[tuple[int, int]] = [(0, 0)]
    while todo:
        i, at = todo.pop()
        node = nodes[i]
        if at == 0 and node.tag in BLOCK:
            flush()
        while at < len(node.parts):
            part = node.parts[at]
            at += 1
            if part.__class__ is str:
                if chosen[i]:
                    current.append(part)
            else:
                if nodes[part].tag == "br":
                    current.append(" ")
                todo.append((i, at))
                todo.append((part, 0))
                break
        else:
            if node.tag in BLOCK:
                flush()
    flush()
    return "\n".join(blocks)


def texts(pages: list[str | None], model: Trees) -> list[str]:
    """Main text of each page; the elements of all pages are scored at once."""
    trees = [parsed(p) if p else [] for p in pages]
    rows = [features(t, len(p)) for t, p in zip(trees, pages) if t]
    if not rows:
        return [""] * len(pages)
    x = np.concatenate(rows)
    odds = model.log_odds(x)
    # Inline elements go with their block, unless markup sets them apart.
    own = (x[:, FEATURES.index("inline")] == 0) | (x[:, 1] + x[:, 3] > 0)
    weight = np.where(own, 1 + x[:, FEATURES.index("own_text")], 0)
    out, at = [], 0
    for tree in trees:
        if not tree:
            out.append("")
            continue
        part = slice(at, at + len(tree))
        at += len(tree)
        out.append(rendered(tree, decoded(tree, odds[part], weight[part])))
    return out


def fit(pages: DataFrame, key: str = "page_id", html: str = "html", most: int = FIT_PAGES) -> Trees:
    """Trees for these pages, from a bounded sample of them."""
    hashed = pages.where(F.col(html).isNotNull()).select(F.xxhash64(F.col(key), F.lit(SEED)).alias("_llm_h"), F.col(html).alias("_llm_page"))
    share = min(1.0, 2.0 * most / max(1, pages.count()))
    near = hashed.where(F.col("_llm_h").bitwiseAND(F.lit((1 << 31) - 1)) <= F.lit(int(share * (1 << 31))))
    rows = near.orderBy("_llm_h", F.xxhash64("_llm_page")).limit(most).collect()
    return trained([r[1] for r in rows])


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", model: Trees | None = None) -> DataFrame:
    """(key, url, text, n_chars) per page."""
    spark = pages.sparkSession
    bounded_batches(spark)
    sent = shared_value(spark, model or fit(pages, key, html))
    kinds = [pages.schema[c].dataType.simpleString() for c in (key, url)]
    slim = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))

    def run(batches):
        trees = received(sent)
        for batch in batches:
            for part in chunks([batch], "html", 1_000_000):
                made = texts(part["html"].to_pylist(), trees)
                yield pa.RecordBatch.from_arrays(
                    [part["key"], part["url"], pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())], ["key", "url", "text", "n_chars"])

    return slim.mapInArrow(run, f"key {kinds[0]}, url {kinds[1]}, text string, n_chars long").withColumnsRenamed({"key": key, "url": url})
