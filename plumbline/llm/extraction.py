"""Main text of web pages by gradient-boosted trees over DOM nodes and hierarchical decoding."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.dom import Node, parse
from plumbline.llm.names import free_name

#: Pages that the trees are fitted on at most, pages composed for training, size of the ensemble.
SAMPLE_PAGES, COMPOSED_PAGES, TREES, DEPTH = 80, 240, 12, 4
SAMPLE_CHARS = 1 << 20
#: Log-odds kept for an attribute token at most, cost of passing through a block that is neither.
TOKEN_LIMIT, THROUGH = 4.0, 0.7

# Element groups, and words that page authors use for attribute values.
TAG_GROUPS = (
    ("article", "main"), ("section",), ("div", "td", "center"), ("p",), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl", "menu"),
    ("li", "dt", "dd"), ("table", "tbody", "tr", "th"), ("blockquote", "pre"), ("figure", "figcaption"), ("nav",), ("header",),
    ("footer",), ("aside",), ("form", "fieldset", "dialog"),
)
MAIN_TAGS, SIDE_TAGS = frozenset(("article", "main")), frozenset("nav header footer aside form dialog fieldset search".split())
MAIN_WORDS = "article body content entry main post story text page".split()
SIDE_WORDS = (
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie copyright disqus dropdown"
    " footer gdpr header login masthead menu meta modal nav navbar navigation newsletter notice notification outbrain"
    " overlay pager pagination popup privacy promo promoted recommended related reply respond search share sharing"
    " sidebar signup skyscraper social sponsor sponsored subscribe tags teaser toolbar topbar warning widget"
).split()


@dataclass
class Trees:
    """Weighted regression trees as flat arrays; ``tokens`` holds log-odds of attribute words."""

    tokens: dict[str, float]
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: list[tuple[int, float]]

    def probability(self, x: np.ndarray) -> np.ndarray:
        """P(main text) per row of node features."""
        margin = np.zeros(len(x))
        rows = np.arange(len(x))
        for root, weight in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go_left = x[rows, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(inner, np.where(go_left, self.left[at], self.right[at]), at)
            margin += weight * self.value[at]
        return 1.0 / (1.0 + np.exp(np.clip(-2.0 * margin, -60, 60)))


_GROUP = {t: i for i, group in enumerate(TAG_GROUPS) for t in group}


def node_features(nodes: list[Node], tokens: dict[str, float]) -> np.ndarray:
    """One row per node: tag group, attribute words (own and above), depth, position among siblings, and text, link
    and element counts of the subtree, alone and against the parent's and the page's."""
    n = len(nodes)
    chars, link_chars, elements, links = np.zeros(n), np.zeros(n), np.ones(n), np.zeros(n)
    paragraphs, words, stops = np.zeros(n), np.zeros(n), np.zeros(n)
    depth = np.zeros(n)
    own = np.zeros(n)
    for i, node in enumerate(nodes):
        if node.parent >= 0:
            depth[i] = depth[node.parent] + 1
        if node.hidden:
            continue
        own[i] = chars[i] = sum(len(t) for _, t in node.runs)
        words[i] = sum(t.count(" ") + 1 for _, t in node.runs)
        stops[i] = sum(t.count(".") + t.count(",") for _, t in node.runs)
        link_chars[i], links[i] = min(node.link_chars, chars[i]), node.links
        elements[i] += node.inline
        paragraphs[i] = node.tag == "p"
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        for a in (chars, link_chars, elements, links, paragraphs, words, stops):
            a[p] += a[i]
    alike = Counter((x.parent, x.tag) for x in nodes)  # siblings of one tag, the node itself among them
    out = np.zeros((n, len(TAG_GROUPS) + 20))
    g = len(TAG_GROUPS)
    low, high = np.zeros(n), np.zeros(n)
    main, side = np.zeros(n), np.zeros(n)
    for i, node in enumerate(nodes):
        odds = [tokens.get(t, 0.0) for t in node.tokens]
        worst, best = min(odds, default=0.0), max(odds, default=0.0)
        up = node.parent
        low[i] = min(worst, low[up]) if up >= 0 else worst
        high[i] = max(best, high[up]) if up >= 0 else best
        main[i] = node.tag in MAIN_TAGS or (up >= 0 and main[up])
        side[i] = node.tag in SIDE_TAGS or (up >= 0 and side[up])
        if (k := _GROUP.get(node.tag)) is not None:
            out[i, k] = 1.0
        kin = nodes[up].children if up >= 0 else [i]
        same = alike[up, node.tag]
        out[i, g : g + 6] = (worst, best, depth[i], len(kin), same / len(kin), len(node.children))
        out[i, g + 6] = (i - kin[0]) / max(kin[-1] - kin[0], 1)
    parent = np.maximum([x.parent for x in nodes], 0)
    out[:, g + 7] = low
    out[:, g + 8] = high
    out[:, g + 9] = main
    out[:, g + 10] = side
    out[:, g + 11] = np.log1p(chars)
    out[:, g + 12] = chars / elements
    out[:, g + 13] = link_chars / np.maximum(chars, 1)
    out[:, g + 14] = links / elements
    out[:, g + 15] = chars / max(chars[0], 1)
    out[:, g + 16] = chars / np.maximum(chars[parent], 1)
    out[:, g + 17] = stops / np.maximum(words, 1)
    out[:, g + 18] = np.log1p(paragraphs)
    out[:, g + 19] = np.log1p(own)
    return out


def decode(nodes: list[Node], p: np.ndarray) -> list[bool]:
    """Which nodes are main text: the most likely labelling in which nothing below a left-out block is taken.

    A node is passed through (its own text is left out, anything may stand below), main (main or left-out blocks
    below) or left out (with all below); one bottom-up pass scores the three, one top-down pass picks."""
    n = len(nodes)
    p = np.clip(p, 1e-6, 1 - 1e-6)
    take, leave = np.log(p), np.log(1 - p)
    out = leave.copy()
    inside, through = take.copy(), np.full(n, -THROUGH)
    for i in range(n - 1, 0, -1):
        if nodes[i].hidden:
            continue
        up = nodes[i].parent
        out[up] += out[i]
        inside[up] += max(inside[i], out[i])
        through[up] += max(through[i], inside[i], out[i])
    state = ["out"] * n
    state[0] = "through"
    for i in range(1, n):
        above = state[nodes[i].parent]
        if nodes[i].hidden or above == "out":
            continue
        if above == "main":
            state[i] = "main" if inside[i] >= out[i] else "out"
        else:
            state[i] = max(("main", inside[i]), ("through", through[i]), ("out", out[i]), key=lambda s: s[1])[0]
    return [s == "main" for s in state]


def main_text(nodes: list[Node], taken: list[bool]) -> str:
    runs = sorted(run for node, t in zip(nodes, taken) if t and not node.hidden for run in node.runs)
    return "\n".join(text for _, text in runs)


def _weak_labels(nodes: list[Node]) -> list[int]:
    """1 inside the page's first article or main element, 0 in side elements and beside it, -1 for what is above it,
    hidden, or on a page without one. Composed pages state labels by a ``data-y`` attribute."""
    label = [-1] * len(nodes)
    if any("data-y" in x.attributes for x in nodes):
        for i, x in enumerate(nodes[1:], 1):
            if 'data-y="' in x.attributes:
                label[i] = int(x.attributes.split('data-y="', 1)[1][0])
            elif label[x.parent] >= 0:
                label[i] = label[x.parent]
        return [-1 if x.hidden else y for x, y in zip(nodes, label)]
    root = next((i for i, x in enumerate(nodes) if x.tag in MAIN_TAGS and not x.hidden), None)
    if root is None:
        return label
    above, up = set(), root
    while up >= 0:
        up = nodes[up].parent
        above.add(up)
    for i, x in enumerate(nodes):
        if x.hidden or i in above:
            continue
        if i == root or (x.parent >= 0 and label[x.parent] == 1 and x.tag not in SIDE_TAGS):
            label[i] = int(not any(t in SIDE_WORDS for t in x.tokens))
        else:
            label[i] = 0
    return label


def compose_page(rng: random.Random, texts: list[str]) -> str:
    """A page with known labels: main text and side blocks of varied markup, filled with given texts."""

    def words(n: int) -> str:
        w = rng.choice(texts).split() or ["x"]
        a = rng.randrange(len(w))
        return " ".join((w[a:] + w[:a])[:n])

    def side(inner: bool = False) -> str:
        word = rng.choice(SIDE_WORDS)
        kind = rng.randrange(6)
        mark = rng.choice((f'class="{word}"', f'id="{word}"', f'class="{word}-{rng.choice(["box", "wrap", "list", "top"])}"'))
        if kind == 0:
            items = "".join(f'<li><a href="/{i}">{words(rng.randint(1, 3))}</a></li>' for i in range(rng.randint(2, 9)))
            return f'<nav data-y="0"><ul>{items}</ul></nav>' if rng.random() < 0.5 else f'<div {mark} data-y="0"><ul>{items}</ul></div>'
        if kind == 1:
            return f'<div {mark} data-y="0">{words(rng.randint(2, 25))}</div>'
        if kind == 2:
            tag = rng.choice(["aside", "footer", "form"] + ([] if inner else ["header"]))
            return f'<{tag} data-y="0"><p>{words(rng.randint(2, 30))}</p></{tag}>'
        if kind == 3:
            many = "".join(f"<p>{words(rng.randint(5, 60))}</p>" for _ in range(rng.randint(1, 5)))
            return f'<div {mark} data-y="0"><h3>{words(2)}</h3>{many}</div>'
        if kind == 4:
            many = "".join(f'<div class="comment"><p>{words(rng.randint(5, 60))}</p></div>' for _ in range(rng.randint(1, 4)))
            return f'<section class="comments" data-y="0"><h2>{words(2)}</h2>{many}</section>'
        return f'<section {mark} data-y="0"><p>{words(rng.randint(3, 20))} <a href="#">{words(2)}</a></p></section>'

    def body() -> str:
        parts = [f"<h1>{words(rng.randint(1, 12))}</h1>"]
        if rng.random() < 0.15:
            parts = [f'<header data-y="1">{parts[0]}</header>']
        for _ in range(rng.randint(1, 18)):
            kind = rng.random()
            if kind < 0.78:
                parts.append(f"<p>{words(rng.choice([1, 2, 4, 10, 30, 80, 200]))}</p>")
            elif kind < 0.86:
                parts.append(f"<h2>{words(rng.randint(1, 8))}</h2>")
            elif kind < 0.9:
                parts.append("<ul>" + "".join(f"<li>{words(rng.randint(1, 15))}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif kind < 0.93:
                parts.append(f"<blockquote><p>{words(30)}</p></blockquote>")
            else:
                parts.append(side(inner=True))
        if rng.random() < 0.3:
            parts.append(side(inner=True))
        inner = "".join(parts)
        kind = rng.random()
        if kind < 0.45:
            return f'<article data-y="1">{inner}</article>'
        if kind < 0.6:
            return f'<main data-y="1">{inner}</main>'
        name = rng.choice(MAIN_WORDS) + rng.choice(["", "-body", "-content", "-text"])
        return f'<div {rng.choice(["class", "id"])}="{name}" data-y="1">{inner}</div>'

    whole = [side() for _ in range(rng.randint(1, 4))] + [body()] + [side() for _ in range(rng.randint(0, 4))]
    page = "".join(whole)
    for _ in range(rng.randint(0, 2)):
        page = f"<div>{page}</div>" if rng.random() < 0.5 else f'<div id="{rng.choice(["page", "wrapper", "container"])}">{page}</div>'
    return f"<html><head><title>{words(4)}</title></head><body>{page}</body></html>"


def fit(pages: DataFrame, html: str = "html", sample_pages: int = SAMPLE_PAGES, composed: int = COMPOSED_PAGES) -> Trees:
    """Trees fitted on nodes of at most ``sample_pages`` pages, chosen by hash and labelled by their article or main
    element, and of ``composed`` pages built around texts of that sample. Pages of over ``SAMPLE_CHARS`` characters
    are not among them. Hashes are ranked alone; only the pages of the lowest ones reach the driver."""
    spark: SparkSession = pages.sparkSession
    rows = pages.where(F.length(html).between(1, SAMPLE_CHARS)).select(F.xxhash64(html).alias("h"), F.col(html).alias("t"))
    top = rows.select("h").distinct().orderBy("h").limit(sample_pages).agg(F.max("h")).first()[0]
    lowest = rows.where(F.col("h") <= F.lit(top)).dropDuplicates(["h"]) if top is not None else rows.limit(0)
    held = [parse(r.t) for r in lowest.orderBy("h").limit(sample_pages).collect()]
    texts = [t for nodes in held for x in nodes if not x.hidden for _, t in x.runs] or ["some words, in a row."]
    rng = random.Random(7)
    held += [parse(compose_page(rng, texts)) for _ in range(composed)]
    labels = [_weak_labels(nodes) for nodes in held]
    seen: dict[str, list[int]] = {}
    for nodes, ys in zip(held, labels):
        for x, y in zip(nodes, ys):
            if y >= 0:
                for t in set(x.tokens):
                    seen.setdefault(t, [0, 0])[y] += 1
    odds = {t: float(np.log((b + 0.5) / (a + 0.5))) for t, (a, b) in seen.items() if a + b >= 2}
    tokens = {t: max(-TOKEN_LIMIT, min(TOKEN_LIMIT, v)) for t, v in odds.items()}
    data = []
    for nodes, ys in zip(held, labels):
        x = node_features(nodes, tokens)
        data += [(float(y), Vectors.dense(v)) for y, v in zip(ys, x) if y >= 0]
    frame = spark.createDataFrame(data, ["label", "features"]).coalesce(1)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.4, seed=7).fit(frame)
    flat: list[list] = []

    def walk(node) -> int:
        at = len(flat)
        flat.append([-1, 0.0, 0, 0, float(node.prediction())])
        if node.subtreeDepth() > 0:
            flat[at][0], flat[at][1] = node.split().featureIndex(), float(node.split().threshold())
            flat[at][2] = walk(node.leftChild())
            flat[at][3] = walk(node.rightChild())
        return at

    roots = [(walk(t._call_java("rootNode")), float(w)) for t, w in zip(model.trees, model.treeWeights)]
    cols = [np.array(c) for c in zip(*flat)]
    return Trees(tokens, *cols, roots)


def extract(pages: DataFrame, trees: Trees, html: str = "html", name: str = "text") -> DataFrame:
    """``pages`` without ``html`` but with its main text as ``name`` (an existing column of that name is replaced).

    Character references are decoded, white space inside a block becomes one space, blocks stand in page order,
    parted by a line break. Scripts, styles and form controls are never text. Null, empty and textless pages give an
    empty text. Rows are independent; repeated rows are all kept. An empty table gives an empty result."""
    rest = [f for f in pages.schema.fields if f.name not in (html, name)]
    body = free_name("_html", pages.columns)
    schema = T.StructType([*rest, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                held = [parse(t) for t in part.column(body).to_pylist()]
                p = trees.probability(np.concatenate([node_features(n, trees.tokens) for n in held]))
                texts, first = [], 0
                for nodes in held:
                    texts.append(main_text(nodes, decode(nodes, p[first : first + len(nodes)])))
                    first += len(nodes)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in rest), pa.array(texts, pa.string())], schema.names)

    return pages.select(*[f.name for f in rest], F.col(html).alias(body)).mapInArrow(run, schema)
