"""The main text of raw web pages, by boosted trees over the nodes of their trees.

Each node of a page (``dom.parse``) is described by its subtree (characters an
element, share of links, marks, paragraphs, form fields), its attribute tokens and
those around it, its depth, and its place and share among its siblings. Trees, grown
like those of the quality rules and scored as flat arrays, give the probability that a
node holds main text. Hierarchical decoding then takes the likeliest choice for the
whole page in which a node without main text has no node with main text below it, and
a node with main text has one: log probabilities are added up from the leaves, and the
better choice is handed down from the page.

The tables have no labelled nodes. The trees learn from pages whose labels are known:
of a sample of at most ``PAGES`` pages those that name their own article (at most
``LEARNT`` nodes each), and pages that are put together for them, seeded layouts of many
kinds (with and without telling elements and attributes) around at most ``PIECES``
pieces of ``PIECE`` characters of each page of the sample. Pages to extract from are
always read whole.

Kept runs of text are joined within blocks, character references are decoded, white
space is made one space, and blocks are joined by a newline; table cells are blocks,
and a line break within a block is white space. The article's own heading belongs to
the article. A null or empty page, and one without main text, gives an empty string.
Repeated rows and ids are rows of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import layouts
from .common import Memo, map_text
from .dom import Node, parse
from .quality import Trees, grow

#: Bounds of what the trees learn from: pages, pieces of text of each, and characters of a piece; then pages put together.
PAGES, PIECES, PIECE, LAYOUTS = 100, 20, 300, 400
#: Nodes of a page of the sample that are learnt from.
LEARNT = 300
#: Nodes that are scored together.
NODES = 20_000
SLICE = 2 << 20
# Attribute tokens, by what they tell.
TOKENS = {
    "content": r"article|content|entry|post|story|main|body|text|prose|page",
    "menu": r"nav|menu|breadcrumb|tabs?$|pagination|pager|toc|links?$|navi",
    "edge": r"head(?!l)|masthead|banner|foot|copyright|top$|bottom|logo|brand|legal",
    "side": r"side|aside|rail|widget|column|right|left|related|recommend|more|popular|trending|teaser|promo",
    "notice": r"cookie|consent|gdpr|notice|alert|privacy|modal|popup|overlay|toast|warning|paywall",
    "advert": r"ads?$|adv|sponsor|banner|dfp|commercial|werbung|publi|anzeige",
    "form": r"form|search|login|signin|signup|subscri|newsletter|input|contact|field",
    "comment": r"comment|repl|discuss|disqus|respon|feedback|thread|kommentar|review|guestbook",
    "share": r"share|social|follow|tweet|facebook|twitter|like",
}
#: What isn't the article although it lies in it: by tag, and by all kinds of token but the first.
_APART, _OTHER = frozenset("nav header footer aside form button select".split()), (1 << len(TOKENS)) - 2
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_GROUPS = [re.compile(p) for p in TOKENS.values()]
KINDS = ("p pre blockquote", "h1 h2 h3 h4 h5 h6", "li dd dt", "ul ol dl menu", "table tbody tr td th", "form input button select label textarea fieldset", "nav", "header", "footer", "aside", "article main", "section", "div center", "#text", "body html #page")
_KIND = {t: i for i, k in enumerate(KINDS) for t in k.split()}
_MARKS = re.compile(r"[.!?…。]")
_LEAD = re.compile(r"\W*(?:\d+\W+)?(?:comment|kommentar|comentari|repl(?:y|ies)|antwort|respuesta|réponse|leave a|discussion)", re.I)
_STATED = ("cookie", "©", "(c) ", "copyright", "powered by", "all rights reserved", "advert", "sponsored", "anzeige", "werbung", "publicité", "publicidad", "subscribe", "newsletter", "sign up", "log in")
N_FEATURES = 30 + 3 * len(TOKENS) + 2 * len(KINDS)


def _groups(names: str) -> int:
    """A bit for each kind of attribute token."""
    found = 0
    for token in _TOKEN.findall(names):
        token = token.lower()
        for i, group in enumerate(_GROUPS):
            if group.match(token):
                found |= 1 << i
    return found


_GROUPS_OF = Memo(_groups, 20_000)


class Page:
    """The columns of a page's nodes."""

    def __init__(self, nodes: list[Node]):
        n = len(nodes)
        self.nodes = nodes
        self.parent = np.array([x.parent for x in nodes], dtype=np.int64)
        end, up = list(range(1, n + 1)), self.parent.tolist()
        depth = [0] * n
        for i in range(n - 1, 0, -1):
            if end[i] > end[up[i]]:
                end[up[i]] = end[i]
        for i in range(1, n):
            depth[i] = depth[up[i]] + 1
        self.end, self.depth = np.array(end), np.array(depth)

    def features(self) -> np.ndarray:
        nodes, parent, end = self.nodes, np.maximum(self.parent, 0), self.end
        n, first = len(nodes), np.arange(len(nodes))
        texts = [x.text for x in nodes]
        chars = np.array([len(t) - t.count(" ") for t in texts], dtype=float)
        words = np.array([t.count(" ") + 1 if t else 0 for t in texts], dtype=float)
        marks = np.array([len(_MARKS.findall(t)) if t else 0 for t in texts], dtype=float)
        commas = np.array([t.count(",") for t in texts], dtype=float)
        digits = np.array([sum(map(t.count, "0123456789")) for t in texts], dtype=float)
        stop = np.array([t.rstrip()[-1:] in (".", "!", "?", "…", ":", '"', "”", "»") for t in texts], dtype=float)
        linked = np.minimum(np.array([x.linked for x in nodes], dtype=float), chars)
        lead = np.array([bool(t) and bool(_LEAD.match(t)) for t in texts], dtype=float)
        stated = np.array([bool(t) and any(w in low for low in (t.lower(),) for w in _STATED) for t in texts], dtype=float)
        tags = np.array([_KIND.get(x.tag, 12) for x in nodes])
        kind = tags[:, None] == np.arange(len(KINDS))
        of = np.array([_GROUPS_OF[x.names] if x.names else 0 for x in nodes], dtype=np.int64)
        runs, elements = (tags == 13).astype(float), (tags != 13).astype(float)

        def below(values: np.ndarray) -> np.ndarray:
            """Sums over the subtrees, which are ranges of the page."""
            total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
            return total[end] - total[first]

        c, w, m, co, d, st, li, r, el, ld, sa = below(np.stack([chars, words, marks, commas, digits, stop, linked, runs, elements, lead, stated], axis=1)).T
        counts = below(kind[:, [0, 1, 2, 5]].astype(float))
        above, edge, article = of.tolist(), ((tags >= 6) & (tags <= 9)).tolist(), (tags == 10).tolist()
        up = parent.tolist()
        for i in range(1, n):  # what is said anywhere on the way down
            above[i] |= above[up[i]]
            edge[i] += edge[up[i]]
            article[i] += article[up[i]]
        above = np.array(above)
        # siblings
        order = np.lexsort((first, self.parent))
        starts = np.flatnonzero(np.diff(self.parent[order], prepend=-2))
        sizes = np.diff(np.append(starts, n))
        place = np.empty(n)
        place[order] = np.arange(n) - np.repeat(starts, sizes)
        among = np.empty(n)
        among[order] = np.repeat(sizes, sizes)
        density = c / (el + 1)
        before, after = np.zeros(n), np.zeros(n)
        same = order[1:][self.parent[order[1:]] == self.parent[order[:-1]]]
        left = order[:-1][self.parent[order[1:]] == self.parent[order[:-1]]]
        before[same], after[left] = density[left], density[same]
        _, twin = np.unique(parent * 64 + tags, return_inverse=True)
        twins = np.bincount(twin)[twin]
        usual = np.bincount(twin, weights=w)[twin] / twins  # words of siblings with the same tag
        seen = np.maximum.accumulate(lead)  # comments have been named before
        whole = max(c[0], 1)
        so_far = np.cumsum(chars) - chars
        cc, ww, rr = np.maximum(c, 1), np.maximum(w, 1), np.maximum(r, 1)
        wide = [
            np.log1p(c), np.log1p(w), li / cc, np.log1p(c / (el + 1)), m / ww, co / ww, np.log1p(w / rr), st / rr, d / cc, ld, sa / rr,
            *np.log1p(counts).T,
            self.depth, so_far / whole, c / whole, c / np.maximum(c[parent], 1), place / among, np.log1p(among), np.log1p(twins), np.log1p(before), np.log1p(after), np.array(edge, dtype=float), np.array(article, dtype=float), seen, np.log1p(usual), (li / cc)[parent], np.log1p(counts[parent, 0]),
        ]
        bits = [(x[:, None] >> np.arange(len(TOKENS)) & 1).astype(float) for x in (of, above, of[parent])]
        return np.concatenate([np.stack(wide, axis=1), *bits, kind, kind[parent]], axis=1)

    def decode(self, p: np.ndarray) -> np.ndarray:
        """Which nodes are kept, given each node's probability of main text."""
        n = len(self.nodes)
        p = np.clip(p, 1e-4, 1 - 1e-4)
        keep, drop = np.log(p), np.log1p(-p)
        text = [bool(x.text) for x in self.nodes]
        has = np.concatenate([[0], np.cumsum(text)])
        some = (has[self.end] - has[:n]) > 0
        keep[~some], drop[~some] = -np.inf, 0.0  # nothing to keep, nothing lost
        keep[0] = drop[0] = 0.0
        total = np.concatenate([[0.0], np.cumsum(drop)])
        drop = (total[self.end] - total[:n]).tolist()  # of the whole subtree
        keep, up = keep.tolist(), self.parent.tolist()
        gain = [0.0] * n  # of the children that gain by being kept
        most, which = [-np.inf] * n, [-1] * n  # the child that gains most, or loses least
        base = [0.0] * n  # the children's subtrees dropped
        for i in range(n - 1, -1, -1):
            if not text[i] and some[i]:
                keep[i] += base[i] + (gain[i] if gain[i] > 0 else most[i])
            if i:
                j, more = up[i], keep[i] - drop[i]
                base[j] += drop[i]
                if more > 0:
                    gain[j] += more
                if more > most[j]:
                    most[j], which[j] = more, i
        kept = [False] * n
        kept[0] = some[0] and keep[0] > drop[0]
        for i in range(1, n):
            j = up[i]
            kept[i] = kept[j] and bool(some[i]) and (keep[i] > drop[i] or which[j] == i and gain[j] <= 0)
        return np.array(kept)

    def text(self, kept: np.ndarray) -> str:
        blocks: list[list[str]] = []
        last = -1
        for i in np.flatnonzero(kept).tolist():
            x = self.nodes[i]
            if x.text:
                if x.block != last:
                    blocks.append([])
                    last = x.block
                blocks[-1].append(x.text)
        joined = (" ".join("".join(b).split()) for b in blocks)
        return "\n".join(b for b in joined if b)


def extract(pages: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page."""
    out = [""] * len(pages)
    waiting: list[tuple[int, Page, np.ndarray]] = []

    def finish() -> None:
        if waiting:
            x = np.concatenate([f for _, _, f in waiting])
            p = np.concatenate([trees.probability(x[i : i + NODES]) for i in range(0, len(x), NODES)])
            at = 0
            for i, page, f in waiting:
                out[i] = page.text(page.decode(p[at : at + len(f)]))
                at += len(f)
            waiting.clear()

    held = 0
    for i, html in enumerate(pages):
        if html:
            page = Page(parse(html))
            waiting.append((i, page, page.features()))
            held += len(page.nodes)
            if held > NODES:
                finish()
                held = 0
    finish()
    return out


def _labelled(nodes: list[Node], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of the nodes with text: 1 if a run ``inside`` lies below."""
    page, n = Page(nodes), np.arange(len(nodes))
    has, good = (np.concatenate([[0], np.cumsum(v)]) for v in ([bool(x.text) for x in nodes], inside))
    some = has[page.end] - has[n] > 0
    some[0] = False
    return page.features()[some], (good[page.end] - good[n] > 0).astype(float)[some]


def from_layout(html: str) -> tuple[np.ndarray, np.ndarray]:
    """Of a page that was put together: its main texts stand in marks."""
    nodes = parse(html)
    inside = np.array([x.text.lstrip().startswith(layouts.MARK) for x in nodes])
    return _labelled([x._replace(text=x.text.replace(layouts.MARK, "")) for x in nodes], inside)


def from_names(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray] | None:
    """Of a page that says itself what its article is: one article element, and
    nothing in it that names itself something else. None of other pages."""
    if sum(x.tag == "article" for x in nodes) != 1:
        return None
    inside = [False] * len(nodes)
    for i, x in enumerate(nodes[1:], 1):
        named = _GROUPS_OF[x.names] & _OTHER if x.names else 0
        inside[i] = x.tag == "article" or inside[x.parent] and not named and x.tag not in _APART
    return _labelled(nodes, np.array([k and bool(x.text) for k, x in zip(inside, nodes, strict=True)]))


def pieces(pages: DataFrame) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
    """Of a bounded sample of pages, the first in a seeded order: pieces of their
    texts, and the features and labels of those that name their article."""
    order = F.xxhash64(F.col("page_id"), F.md5(F.col("html")))
    sample = pages.where("html IS NOT NULL AND html <> ''").orderBy(order, "page_id").limit(PAGES).select(order.alias("place"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for place, html in zip(b.column("place").to_pylist(), b.column("html").to_pylist(), strict=True):
                nodes = parse(html)
                texts = sorted((" ".join(x.text.split())[:PIECE] for x in nodes if x.text.count(" ") > 2), key=len, reverse=True)[:PIECES]
                x, y = from_names(nodes) or (np.empty((0, N_FEATURES)), np.empty(0))
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (place, texts, list(map(list, x[:LEARNT])), y[:LEARNT])], ["place", "pieces", "x", "y"])

    rows = sample.mapInArrow(run, "place long, pieces array<string>, x array<array<double>>, y array<double>").collect()
    rows.sort(key=lambda r: (r.place, r.pieces))
    found = [p for r in rows for p in r.pieces]
    return found or ["some words of a text."], [(np.array(r.x), np.array(r.y)) for r in rows if r.y]


def fit(pages: DataFrame, number: int = LAYOUTS, seed: int = 0) -> Trees:
    """Grow the trees on pages of the sample that name their article and ``number``
    pages that are put together; tasks describe them, and the features of some 70
    nodes a page come to the driver."""
    found, named = pieces(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column("id").to_pylist():
                x, y = from_layout(layouts.page(i + seed * 1_000_003, found))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), i)), pa.array(list(x), pa.list_(pa.float64())), pa.array(y)], ["id", "x", "y"])

    rows = pages.sparkSession.range(0, number, 1, 8).mapInArrow(run, "id long, x array<double>, y double").toArrow()
    order = np.argsort(rows.column("id").to_numpy(), kind="stable")
    x = np.array(rows.column("x").combine_chunks().flatten()).reshape(-1, N_FEATURES)[order]
    x, y = np.concatenate([x, *(n[0] for n in named)]), np.concatenate([rows.column("y").to_numpy()[order], *(n[1] for n in named)])
    return grow(x, y, [0] * N_FEATURES)


def main_text(pages: DataFrame, trees: Trees) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def make():
        def work(b):
            found = extract(b.column("html").to_pylist(), trees)
            return {"page_id": b.column("page_id").cast(pa.int64()), "url": b.column("url"), "text": found, "n_chars": [len(t) for t in found]}

        return work

    return map_text(pages, ["page_id", "url", "html"], "page_id long, url string, text string, n_chars long", make, SLICE, "html")
