"""Language-model scores from a log-frequency Bloom filter.

Counts of words, word pairs and, with an order of 3, word triples are quantised to
levels, whose least counts are THRESHOLDS: exact up to 4, then two a doubling. An
n-gram is entered once for each level up to its own; a lookup probes level
after level until one is missing, so that frequent n-grams cost a few probes
and absent ones about one. A level stands for the mean count q of the n-grams
that have it. Every n-gram of the training texts is entered, those seen once
too. Probabilities back off by history (Dirichlet smoothing):

    p(w)       = (q(w) + 0.5) / (N + 0.5 (V + 1))
    p(w | v)   = (q(v w) + (m2 + f2) p(w)) / (c(v) + m2 + 2 f2)
    p(w | u v) = (q(u v w) + (m3 + f3) p(w | v)) / (q(u v) + m3 + 2 f3)

m2 and m3 are the mean numbers of distinct words that follow a word and a pair.
A history never seen leaves the shorter history's probability as it is. c(v)
is exact for the words of the head. An n-gram counts at most as often as its
history and as itself without its first word, which removes most of what the
filter holds by mistake; f2 = e V q2 and f3 = e (min(r c(v), V) + e V) q3 are about
what is left of it, with e the share of mistaken lookups, measured on the filter,
r the number of distinct pairs a token, and q2 and q3 the counts of level 1. They
stand below the line for the mistakes, and once more on both sides, so that
histories rarer than the mistakes lean on the shorter one. So each distribution sums to 1 but
for quantisation and chance.

The hash of an n-gram picks its part of the filter, and each part is made by one
task from all counts of its n-grams: the counts are shuffled once and each part
is as large as its own entries need. Parts are broadcast in segments of about
SEGMENT_BYTES; a task reads its texts once and looks up a slice of them in one
segment after the other, holding one at a time.

Tokens are the lower-cased words of a text and then one end mark; a text
without words, null texts included, is the end mark alone. The first word
follows an end mark and has no triple. Words are counted by a 64-bit hash: of V
distinct words two fall together with odds of about V squared over 2**65; longer
n-grams are told apart by 40 bits of it within their part, where of some millions
about one in a million falls together with another. Without training
texts N is 0 and every score is 0.
"""

from __future__ import annotations

import math
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_column, lower_words_of, materialise, shuffle_partitions, text_slices, texts

END = "\n"  # no word holds a line end
#: Production scores by words and pairs; a filter with triples is twice as large.
ORDER = 2
#: Least count of each level from 1 on; two a doubling, as far as counts go.
THRESHOLDS = np.array(sorted({math.ceil(2 ** (k / 2)) for k in range(2 * 62)} | {1, 2, 3, 4}), dtype=np.int64)
#: Bits of the filter for each entry, and bits that an entry sets in each of its two words.
BITS_EACH, SET = 12, 3
#: A line of the filter is a cache line of so many 64-bit words.
LINE = 8
SEGMENT_BYTES = 16 << 20
#: Bytes of training text whose n-grams make about one part of the filter.
PART_BYTES = 16 << 20
#: Words whose exact counts are broadcast: the most frequent, 16 bytes each.
HEAD = 1 << 20
#: Words a worker knows at once, and tokens it counts before it passes them on.
KNOWN, HELD = 300_000, 2_000_000
#: Bytes of text that a worker looks up at once, and n-grams that it probes at once.
LOOKED_UP, PROBED = 4 << 20, 1 << 18
#: Random lookups in each part that measure its mistakes.
TRIALS = 1 << 15
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
#: Bytes that are kept of the hash of a pair or triple, next to its part.
SHORT = 5
_LOW = np.uint64((1 << 8 * SHORT) - 1)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; wraps around."""
    x = (x + np.uint64(salt)) * _A
    x ^= x >> np.uint64(29)
    x *= _B
    return x ^ (x >> np.uint64(32))


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(THRESHOLDS, counts, side="right")


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _lines(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What picks an n-gram's line within its part, and what its bits come from."""
    g = mix(h & _LOW, 5)
    return g >> np.uint64(32), g


def _entry(g: np.ndarray, level: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two (word of the line, bits in it) that stand for one level; levels
    take turns at the words."""
    x = (g + np.uint64(level * int(_C) & 0xFFFFFFFFFFFFFFFF)) * _B
    x = (x ^ (x >> np.uint64(32))) * _A >> np.uint64(16)
    word = ((g & np.uint64(LINE - 1)).astype(np.int64) + level) & (LINE - 1)
    other = (word + 1 + (g >> np.uint64(3) & np.uint64(3)).astype(np.int64)) & (LINE - 1)
    out = []
    for w in (word, other):
        mask = np.zeros(len(g), dtype=np.uint64)
        for _ in range(SET):
            mask |= np.uint64(1) << (x & np.uint64(63))
            x = x >> np.uint64(6)
        out.append((w, mask))
    return out


def probe(bits: np.ndarray, base: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The level of each n-gram of which the line starts at a word of ``bits``."""
    level, live = np.zeros(len(g), dtype=np.uint8), np.arange(len(g))
    for current in range(1, len(THRESHOLDS) + 1):
        (word, mask), (other, also) = _entry(g, current)
        keep = np.flatnonzero((bits[base + word] & mask == mask) & (bits[base + other] & also == also))
        if not len(keep):
            break
        base, g, live = base[keep], g[keep], live[keep]
        level[live] = current
    return level


class Ids(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Vocabulary:
    """Words as small numbers, with their hashes. One that is ``full`` is to be
    replaced, with all that is kept of its words, before the next slice."""

    def __init__(self):
        self.number, self.hashes = Ids(), np.zeros(0, dtype=np.uint64)
        self.number[END]
        self._hash_new()

    @property
    def full(self) -> bool:
        return len(self.number) > KNOWN

    def _hash_new(self) -> None:
        from xxhash import xxh64_intdigest as digest

        new = list(islice(self.number, len(self.hashes), None))
        if new:
            self.hashes = np.concatenate((self.hashes, np.array([digest(w, 0) for w in new], dtype=np.uint64)))

    def numbers(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of each token, an end mark (number 0) after each text; and
        the number of tokens of each text."""
        tokens: list[str] = []
        sizes = []
        for text in batch:
            words = lower_words_of(text)
            sizes.append(len(words) + 1)
            tokens += words
            tokens.append(END)
        ids = np.fromiter(map(self.number.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        self._hash_new()
        return ids, np.array(sizes, dtype=np.int64)


def gram_hashes(hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams of 2 words and more that end at each token, and
    which tokens are the first of their texts (they end no triple)."""
    first = np.zeros(len(ids), dtype=bool)
    first[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = True
    shorter, out = hashes[ids], []
    for n in range(2, order + 1):
        before = np.concatenate((hashes[:1] if n == 2 else shorter[:1], shorter[:-1]))
        shorter = mix(before ^ mix(hashes, 2 * n)[ids], 2 * n + 1)
        out.append(shorter)
    return out, first


def _packed(order: int, h: np.ndarray, n: np.ndarray, parts: int):
    """Rows (part, order, h, n) of hashes in order and their counts; pairs and
    triples keep SHORT bytes."""
    of = part_of(h, parts)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1, [len(of)]))
    width = 8 if order == 1 else SHORT
    raw, rows = h.view(np.uint8).reshape(-1, 8)[:, :width], []
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        few = n[a:z].max() < 256
        rows.append((int(of[a]), raw[a:z].tobytes(), n[a:z].astype(np.uint8 if few else np.int64).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([order] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["part", "order", "h", "n"])


def _unpacked(order: int, h: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = 8 if order == 1 else SHORT
    out = np.zeros((len(h) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(h, np.uint8).reshape(-1, width)
    return out.reshape(-1).view(np.uint64), np.frombuffer(n, np.uint8 if len(n) == len(out) else np.int64).astype(np.int64)


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and their counts."""
    if not held:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(h)
    h, n = h[order], n[order]
    start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[start], np.add.reduceat(n, start) if len(h) else n


def count_batches(batches, parts: int, order: int):
    """Packed counts of what a worker holds at a time."""
    words, counts = Vocabulary(), np.zeros(0, np.int64)
    held: list[list[np.ndarray]] = []
    size = 0

    def flush():
        for n in range(2, order + 1):
            h, k = np.unique(np.concatenate([x[n - 2] for x in held]), return_counts=True)
            if len(h):
                yield _packed(n, h, k, parts)
        held.clear()

    def flush_words():
        h, k = _summed([(words.hashes[: len(counts)], counts)])
        if len(h):
            yield _packed(1, h, k, parts)

    for batch in batches:
        for part in text_slices(batch):
            if words.full:
                yield from flush_words()
                words, counts = Vocabulary(), np.zeros(0, np.int64)
            ids, sizes = words.numbers(texts(part))
            more = np.bincount(ids, minlength=len(words.hashes))
            more[: len(counts)] += counts
            counts = more
            grams, first = gram_hashes(words.hashes, ids, sizes, order)
            held.append([g if n == 0 else g[~first] for n, g in enumerate(grams)])
            size += len(ids)
            if size >= HELD:
                yield from flush()
                size = 0
    if held:
        yield from flush()
        yield from flush_words()


def packed_counts(training: DataFrame, parts: int, order: int = ORDER) -> DataFrame:
    """(part, order, h, n) of every worker's counts."""
    return training.select("text").mapInArrow(lambda batches: count_batches(batches, parts, order), "part long, order int, h binary, n binary")


def _part_row(part: int, held: dict[int, list], order: int) -> dict:
    """All that is known of one part: its bits, and what levels its n-grams have."""
    found = {n: _summed(held.get(n, [])) for n in range(1, order + 1)}
    levels = {n: level_of(k) for n, (_, k) in found.items()}
    lines = max(1, -(-int(sum(x.sum() for x in levels.values())) * BITS_EACH // (64 * LINE)))
    bits = np.zeros(lines * LINE, dtype=np.uint64)
    for n, (h, _) in found.items():
        line, g = _lines(h)
        base = (line * np.uint64(lines) >> np.uint64(32)).astype(np.int64) * LINE
        level = levels[n]
        for current in range(1, int(level.max(initial=0)) + 1):
            keep = level >= current
            base, g, level = base[keep], g[keep], level[keep]
            for word, mask in _entry(g, current):
                np.bitwise_or.at(bits, base + word, mask)
    size = len(THRESHOLDS) + 1
    line, g = _lines(np.random.default_rng(part).integers(0, 1 << 63, TRIALS, dtype=np.uint64))
    trials = probe(bits, (line * np.uint64(lines) >> np.uint64(32)).astype(np.int64) * LINE, g)
    return {
        "part": part,
        "lines": lines,
        "bits": bits.tobytes(),
        "mistakes": int((trials > 0).sum()),
        "grams": [np.bincount(levels[n], minlength=size).tolist() for n in found],
        "counts": [np.bincount(levels[n], k, size).astype(np.int64).tolist() for n, (_, k) in found.items()],
        "word_h": found[1][0].view(np.int64).tolist(),
        "word_n": found[1][1].tolist(),
    }


def filter_parts(packed: DataFrame, parts: int, order: int = ORDER) -> DataFrame:
    """One row a part that has n-grams."""
    schema = "part long, lines long, bits binary, mistakes long, grams array<array<long>>, counts array<array<long>>, word_h array<long>, word_n array<long>"

    def run(batches):
        part, held = None, {}
        for batch in batches:
            for p, n, h, k in zip(*(batch.column(c).to_pylist() for c in ("part", "order", "h", "n")), strict=True):
                if p != part:
                    if held:
                        yield pa.RecordBatch.from_pylist([_part_row(part, held, order)], schema=_PART)
                    part, held = p, {}
                held.setdefault(n, []).append(_unpacked(n, h, k))
        if held:
            yield pa.RecordBatch.from_pylist([_part_row(part, held, order)], schema=_PART)

    return packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, schema)


_LONGS = pa.list_(pa.int64())
_PART = pa.schema([("part", pa.int64()), ("lines", pa.int64()), ("bits", pa.binary()), ("mistakes", pa.int64()), ("grams", pa.list_(_LONGS)), ("counts", pa.list_(_LONGS)), ("word_h", _LONGS), ("word_n", _LONGS)])


class Shape(NamedTuple):
    """Where each part of the filter lies: its first line, how many it has
    (none where no n-gram is), and the segment that holds it."""

    first: np.ndarray
    lines: np.ndarray
    segment: np.ndarray


class Statistics(NamedTuple):
    """What the formulas need besides the filter."""

    tokens: int  # N
    distinct: int  # V
    mean: list[np.ndarray]  # q by order and level
    mass: list[float]  # m by order; the first is not used
    error: float  # e
    follow: float  # r, distinct pairs a token


def summary(grams: np.ndarray, counts: np.ndarray, error: float) -> Statistics:
    """From the numbers of n-grams, and the sums of their counts, by order and
    level, and the share of mistaken lookups."""
    usual = np.concatenate(([0], THRESHOLDS))
    mean = [np.where(g > 0, c / np.maximum(g, 1), usual) for g, c in zip(grams, counts, strict=True)]
    distinct = grams.sum(axis=1).tolist()
    mass = [1.0, *(max(1.0, b / max(1, a)) for a, b in zip(distinct, distinct[1:], strict=False))]
    return Statistics(int(counts[0].sum()), int(distinct[0]), mean, mass, error, sum(distinct[1:2]) / max(1, int(counts[0].sum())))


class Model(NamedTuple):
    statistics: Statistics
    shape: Shape
    parts: DataFrame
    head: tuple[np.ndarray, np.ndarray]  # hashes in order, exact counts

    @property
    def tokens(self) -> int:
        return self.statistics.tokens


def train(training: DataFrame, order: int = ORDER) -> Model:
    """Count the texts and fill the filter. The driver gets sums by level, one
    number a part, and the head of the vocabulary."""
    spark = training.sparkSession
    size = training.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-size // PART_BYTES))
    made = materialise(filter_parts(packed_counts(training, parts, order), parts, order), "filter")
    levels = len(THRESHOLDS) + 1
    grams, counts = np.zeros((2, order, levels), dtype=np.int64)
    by_order = made.select(F.posexplode(F.arrays_zip("grams", "counts")).alias("n", "x"))
    by_level = by_order.select("n", F.posexplode(F.arrays_zip("x.grams", "x.counts")).alias("level", "y"))
    for r in by_level.groupBy("n", "level").agg(F.sum("y.grams").alias("grams"), F.sum("y.counts").alias("counts")).collect():
        grams[r.n, r.level], counts[r.n, r.level] = r.grams, r.counts
    # whole levels of the most frequent words, HEAD words at most
    above = np.cumsum(grams[0][::-1])[::-1]
    least = int(np.argmax(above <= HEAD)) if (above <= HEAD).any() else levels
    head = word_counts(made).where(F.col("n") >= int(THRESHOLDS[max(least, 1) - 1] if least <= len(THRESHOLDS) else 1 << 62)).toArrow()
    h, n = head.column("h").to_numpy().view(np.uint64), head.column("n").to_numpy()
    at = np.argsort(h)
    lines, mistakes = np.zeros(parts, dtype=np.int64), 0
    for r in made.select("part", "lines", "mistakes").collect():
        lines[r.part] = r.lines
        mistakes += r.mistakes
    first = np.concatenate(([0], np.cumsum(lines)[:-1]))
    return Model(summary(grams, counts, mistakes / (TRIALS * parts)), Shape(first, lines, first * (LINE * 8) // SEGMENT_BYTES), made, (h[at], n[at]))


def word_counts(parts: DataFrame) -> DataFrame:
    """(h, n) of all words of the training texts."""
    return parts.select(F.explode(F.arrays_zip("word_h", "word_n")).alias("w")).select(F.col("w.word_h").alias("h"), F.col("w.word_n").alias("n"))


def segments(model: Model) -> list:
    """The segments of the filter as broadcasts, made one after the other."""
    shape, context = model.shape, model.parts.sparkSession.sparkContext
    out = []
    for segment in np.unique(shape.segment[shape.lines > 0]).tolist():
        own = np.flatnonzero((shape.segment == segment) & (shape.lines > 0))
        first, last = int(own[0]), int(own[-1])
        start = int(shape.first[first])
        bits = np.zeros((int(shape.first[last] + shape.lines[last]) - start) * LINE, dtype=np.uint64)
        for r in model.parts.where(F.col("part").between(first, last)).select("part", "bits").collect():
            at = (int(shape.first[r.part]) - start) * LINE
            bits[at : at + len(r.bits) // 8] = np.frombuffer(r.bits, dtype=np.uint64)
        out.append((segment, start, context.broadcast(bits)))
    return out


def _value(broadcast):
    """The value of a broadcast, which the worker doesn't keep: it holds one
    segment at a time."""
    value = broadcast.value
    vars(broadcast).pop("_value", None)
    return value


class Filter:
    def __init__(self, shape: Shape, segments: list):
        self.shape, self.segments = shape, segments
        self.kept = _value(segments[0][2]) if len(segments) == 1 else None

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The level of each hash, 0 for those that were not entered."""
        level = np.zeros(len(h), dtype=np.uint8)
        of = self.shape.segment[part_of(h, len(self.shape.lines))] if len(self.segments) > 1 else None
        for segment, start, sent in self.segments:
            bits = self.kept if self.kept is not None else _value(sent)
            own = np.arange(len(h)) if of is None else np.flatnonzero(of == segment)
            for a in range(0, len(own), PROBED):
                live = own[a : a + PROBED]
                part = part_of(h[live], len(self.shape.lines))
                lines = self.shape.lines[part]
                live, part, lines = live[lines > 0], part[lines > 0], lines[lines > 0]
                line, g = _lines(h[live])
                at = self.shape.first[part] - start + (line * lines.astype(np.uint64) >> np.uint64(32)).astype(np.int64)
                level[live] = probe(bits, at * LINE, g)
        return level


class Scorer:
    def __init__(self, statistics: Statistics, head: tuple[np.ndarray, np.ndarray], found: Filter):
        self.s, self.head, self.filter = statistics, head, found
        self.norm = statistics.tokens + 0.5 * (statistics.distinct + 1)
        self.forget()

    def forget(self) -> None:
        self.vocabulary = Vocabulary()
        self.count, self.p, self.history = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

    def look_up(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of the tokens, tokens of each text, log10 probability of
        each token). Of words that are new it learns the exact count where the
        head has it (0 elsewhere), p(w), and c(v) as a history."""
        if self.vocabulary.full:
            self.forget()
        ids, sizes = self.vocabulary.numbers(batch)
        grams, first = gram_hashes(self.vocabulary.hashes, ids, sizes, len(self.s.mean))
        new = self.vocabulary.hashes[len(self.count) :]
        levels = self.filter.levels(np.concatenate((new, *grams)))
        at = np.searchsorted(self.head[0], new)
        hit = at < len(self.head[0])
        hit[hit] = self.head[0][at[hit]] == new[hit]
        count = np.zeros(len(new), np.int64)
        count[hit] = self.head[1][at[hit]]
        q = self.s.mean[0][levels[: len(new)]]
        self.count = np.concatenate((self.count, count))
        self.p = np.concatenate((self.p, (q + 0.5) / self.norm))
        self.history = np.concatenate((self.history, np.where(hit, count, q)))
        p, own = self.p[ids], self.history[ids]
        before = np.concatenate((self.history[:1], own[:-1]))  # c(v)
        strangers = self.s.error * self.s.distinct
        history, mistaken = before, np.full(len(ids), strangers)
        for n in range(1, len(self.s.mean)):
            q = self.s.mean[n][levels[len(new) + (n - 1) * len(ids) :][: len(ids)]]
            q, m = np.minimum(np.minimum(q, history), own), self.s.mass[n]
            false = mistaken * self.s.mean[n][1]
            longer = (q + (m + false) * p) / (history + m + 2 * false)
            p = np.where((history > 0) & ~(first & (n > 1)), longer, p)
            own, history = q, np.concatenate(([0.0], q[:-1]))
            mistaken = self.s.error * (np.minimum(before * self.s.follow, self.s.distinct) + strangers)
        return ids, sizes, np.log10(p)


_SCORED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("tail", _LONGS), ("times", _LONGS)])


def _score_batches(batches, scorer: Scorer):
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        for part in text_slices(batch, limit=LOOKED_UP):
            ids, sizes, log_p = scorer.look_up(texts(part))
            docs = len(sizes)
            of = np.repeat(np.arange(docs), sizes)
            score = np.bincount(of, log_p, docs)
            count = scorer.count[ids]
            inside = count > 0
            known = np.bincount(of, inside, docs).astype(np.int64)
            base = np.bincount(of[inside], np.log10((count[inside] + 0.5) / scorer.norm), docs)
            outside = np.flatnonzero(~inside)
            vocabulary = len(scorer.vocabulary.hashes)
            owner, word, times = (np.zeros(0, np.int64),) * 3
            if len(outside):
                key, times = np.unique(of[outside] * vocabulary + ids[outside], return_counts=True)
                owner, word = np.divmod(key, vocabulary)
            offsets = pa.array(np.searchsorted(owner, np.arange(docs + 1)).astype(np.int32))
            tail = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (scorer.vocabulary.hashes[word].view(np.int64), times.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + docs)), part.column("doc_id"), pa.array(sizes), pa.array(known), pa.array(base), pa.array(score), *tail], schema=_SCORED)
            row += docs


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every text."""
    statistics, shape = model.statistics, model.shape
    head, found = docs.sparkSession.sparkContext.broadcast(model.head), segments(model)

    def run(batches):
        yield from _score_batches(batches, Scorer(statistics, head.value, Filter(shape, found)))

    schema = "row long, doc_id long, n_tokens long, n_known long, base_score double, score double, tail array<long>, times array<long>"
    scored = materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema), "scored")
    # words outside the head: their exact counts come by a join, one row a text and word
    norm = math.log10(statistics.tokens + 0.5 * (statistics.distinct + 1))
    tail = scored.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("h"), F.col("t.times").alias("k"))
    n = F.coalesce("n", F.lit(0))
    more = tail.join(word_counts(model.parts), "h", "left").groupBy("row").agg(F.sum(F.when(n > 0, F.col("k")).otherwise(0)).alias("more_known"), F.sum(F.col("k") * (F.log10(n + 0.5) - norm)).alias("more_base"))
    return scored.drop("tail", "times").join(more, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score"
    )


def held_out_scores(docs: DataFrame, fold: int = 1, order: int = ORDER) -> DataFrame:
    """Scores of all texts under a model of those outside the fold, with
    held_out and train_tokens (N)."""
    model = train(docs.where(fold_column() != fold), order)
    return score(docs, model).select("doc_id", (fold_column() == fold).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
