"""Quality rules by gradient-boosted trees over document statistics.

Trees are grown on binned statistics of labelled documents and laid out as
flat numpy arrays, so that a batch of documents walks all trees together. On
chosen statistics (symbols, repetition) the trees are monotone: more of it
can never raise a document's score.

Two plain rules come first: a document of fewer than 50 words, or more than
half of whose words lie in repeated three-word windows, fails whatever the
trees say. Null and empty texts have no words and so fail. Without labels of
both classes the trees keep everything.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, map_text, texts, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Bound of the sample that the trees are grown on: documents of each class.
PER_CLASS = 8000
TREES, DEPTH, RATE, BINS, LEAST_LEAF, RIDGE = 60, 4, 0.15, 64, 20, 1.0
#: Documents at this probability of quality and above are kept.
KEEP = 0.4
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct", "n_ends")
#: Statistics the trees see; -1 where more of it must not raise the score.
STATISTICS = {"log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "words_a_line": 0, "upper": -1, "digits": -1, "marks": -1, "distinct": 0, "ends": 0}
_UPPER, _DIGITS, _MARKS, _ENDS = (bytes(s, "ascii") for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?|{}[]\\/~^=_", ".!?"))


def repeated_words(words: list[str]) -> int:
    """How many words lie in a three-word window that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    size = len(number)
    pairs = ids[:-1] * size + ids[1:]
    if size > 2_000_000:  # the cube wouldn't fit 63 bits
        _, pairs = np.unique(pairs, return_inverse=True)
    _, inverse, counts = np.unique(pairs[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    inside = np.zeros(n, dtype=bool)
    for k in range(3):
        inside[k : n - 2 + k] |= again
    return int(inside.sum())


def counts(text: str) -> tuple[int, ...]:
    """COUNTS of a text."""
    words = words_of(text)
    if not words:
        return (0,) * len(COUNTS)
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    raw = text.encode()

    def number(which: bytes) -> int:
        return len(raw) - len(raw.translate(None, which))

    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines), number(_UPPER), number(_DIGITS), number(_MARKS), len(set(words)), number(_ENDS))


def statistics(c: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each row of COUNTS."""
    words, chars, symbols, dup, repeat, lines, upper, digits, marks, distinct, ends = c.astype(float).T
    w, ch, ln = np.maximum(words, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    return np.stack([np.log1p(words), chars / w, symbols / w, dup / ln, repeat / w, words / ln, upper / ch, digits / ch, marks / w, distinct / w, ends / w], axis=1)


class Trees(NamedTuple):
    """All trees in flat arrays. A leaf points to itself, so that every
    document takes ``DEPTH`` steps in every tree."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, signs: list[int]) -> Trees:
    """Boost TREES trees of DEPTH levels on logistic loss.

    A split on a signed statistic must order its two leaves by the sign, and
    the mean of the two bounds everything below, so whole trees are monotone.
    """
    n_good = y.sum()
    base = float(np.log((n_good + 0.5) / (len(y) - n_good + 0.5)))
    roots, feature, threshold, left, right, value = [], [], [], [], [], []

    def node() -> int:
        k = len(feature)
        for column, v in ((feature, 0), (threshold, np.inf), (left, k), (right, k), (value, 0.0)):
            column.append(v)
        return k

    def done() -> Trees:
        return Trees(base, *(np.array(v, dtype=t) for v, t in ((roots, np.int32), (feature, np.int32), (threshold, float), (left, np.int32), (right, np.int32), (value, float))))

    if not len(y) or n_good in (0, len(y)):
        base = 30.0
        return done()
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    logit = np.full(len(y), base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        g, h = y - p, p * (1 - p)
        roots.append(node())
        level = [(roots[-1], np.arange(len(y)), -np.inf, np.inf)]
        for depth in range(DEPTH + 1):
            below = []
            for k, rows, low, high in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                value[k] = RATE * float(np.clip(gs / (hs + RIDGE), low, high))
                best = None
                for f in range(x.shape[1]) if depth < DEPTH and len(rows) >= 2 * LEAST_LEAF else ():
                    size = len(edges[f]) + 1
                    of = bins[rows, f]
                    gl, hl, nl = (np.cumsum(np.bincount(of, w, size))[:-1] for w in (g[rows], h[rows], None))
                    vl, vr = np.clip(gl / (hl + RIDGE), low, high), np.clip((gs - gl) / (hs - hl + RIDGE), low, high)
                    gain = gl * vl - 0.5 * (hl + RIDGE) * vl**2 + (gs - gl) * vr - 0.5 * (hs - hl + RIDGE) * vr**2
                    ok = (nl >= LEAST_LEAF) & (len(rows) - nl >= LEAST_LEAF)
                    if signs[f]:
                        ok &= signs[f] * (vr - vl) >= 0
                    if ok.any():
                        i = int(np.argmax(np.where(ok, gain, -np.inf)))
                        if best is None or gain[i] > best[0] + 1e-12:
                            best = (gain[i], f, i, vl[i], vr[i])
                v = value[k] / RATE
                if best is None or best[0] <= gs * v - 0.5 * (hs + RIDGE) * v**2 + 1e-9:
                    logit[rows] += value[k]
                    continue
                _, f, i, vl, vr = best
                feature[k], threshold[k] = f, float(edges[f][i])
                left[k], right[k] = node(), node()
                mid = (vl + vr) / 2
                bounds = {0: ((low, high),) * 2, 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[signs[f]]
                goes = bins[rows, f] <= i
                below += [(left[k], rows[goes], *bounds[0]), (right[k], rows[~goes], *bounds[1])]
            level = below
    return done()


def count(docs: DataFrame) -> DataFrame:
    """(doc_id, COUNTS...) of every text."""

    def make():
        def work(b):
            c = np.array([counts(t) for t in texts(b)], dtype=np.int64).reshape(-1, len(COUNTS))
            return {"doc_id": b.column("doc_id").cast(pa.int64())} | {name: c[:, i] for i, name in enumerate(COUNTS)}

        return work

    return map_text(docs, ["doc_id", "text"], "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS), make)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Trees:
    """Grow the trees on at most ``per_class`` labelled documents of each
    class; only their counts reach the driver."""
    sample = labelled_sample(docs, labels, "quality", per_class)

    def run(batches):
        for b in batches:
            c = np.array([counts(t) for t in texts(b)], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), *(pa.array(x) for x in c.T)], ["doc_id", "label", *COUNTS])

    rows = sample.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, " + ", ".join(f"{c} long" for c in COUNTS)).toPandas()
    rows = rows.sort_values(["doc_id", *COUNTS], kind="stable")
    return grow(statistics(rows[list(COUNTS)].to_numpy()), rows["label"].to_numpy(dtype=float), list(STATISTICS.values()))


def _judge(c: np.ndarray, trees: Trees, keep: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base_failed, probability of quality, kept) for rows of COUNTS."""
    words, repeats = c[:, 0], c[:, 4]
    failed = (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)
    p = trees.probability(statistics(c))
    return failed, p, ~failed & (p >= keep)


def judge(docs: DataFrame, trees: Trees, keep: float = KEEP) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, quality, kept) of every text."""
    shown = COUNTS[:5]

    def make():
        def work(b):
            c = np.array([counts(t) for t in texts(b)], dtype=np.int64).reshape(-1, len(COUNTS))
            failed, p, kept = _judge(c, trees, keep)
            return {"doc_id": b.column("doc_id").cast(pa.int64()), "base_failed": failed, "quality": p, "kept": kept} | {n: c[:, i] for i, n in enumerate(shown)}

        return work

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in shown) + ", base_failed boolean, quality double, kept boolean"
    return map_text(docs, ["doc_id", "text"], schema, make)


def accept(docs: DataFrame, trees: Trees, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose texts are kept."""
    from .common import text_slices

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                c = np.array([counts(t) for t in texts(part)], dtype=np.int64).reshape(-1, len(COUNTS))
                yield part.filter(pa.array(_judge(c, trees, keep)[2]))

    return docs.mapInArrow(run, docs.schema)


def digests(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", *COUNTS[:5], "base_failed", "kept", F.col("quality"))
