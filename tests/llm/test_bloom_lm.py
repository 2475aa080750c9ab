"""The language model against plain counts."""

import collections
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from modetrace.llm import bloom_lm, common

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens_of(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or "")), bloom_lm.END]


class Plain:
    """The documented formulas over exact counts of lists of tokens."""

    def __init__(self, training, order=bloom_lm.ORDER, head=bloom_lm.HEAD, error=0.0):
        self.error = error
        self.n = [collections.Counter() for _ in range(order)]
        for t in training:
            padded = [bloom_lm.END, *t]
            self.n[0].update(t)
            for k in range(1, order):
                self.n[k].update(tuple(padded[i - k : i + 1]) for i in range(k, len(padded)))
        self.tokens, self.distinct = sum(self.n[0].values()), len(self.n[0])
        levels = collections.Counter(self.level(x) for x in self.n[0].values())
        self.head_level = min((k for k in range(1, 200) if sum(n for level, n in levels.items() if level >= k) <= head))
        self.mean = []
        for c in self.n:
            by = collections.defaultdict(list)
            for x in c.values():
                by[self.level(x)].append(x)
            self.mean.append({k: sum(v) / len(v) for k, v in by.items()})
        self.mass = [None, *(max(1.0, len(b) / max(1, len(a))) for a, b in zip(self.n, self.n[1:], strict=False))]

    @staticmethod
    def level(x):
        return sum(t <= x for t in bloom_lm.THRESHOLDS.tolist())

    def q(self, k, gram):
        c = self.n[k].get(gram, 0)
        return self.mean[k][self.level(c)] if c else 0.0

    def history(self, v):
        c = self.n[0].get(v, 0)
        return c if self.level(c) >= self.head_level else self.q(0, v)

    def base(self, t):
        return sum(math.log10((self.n[0][w] + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))) for w in t)

    def score(self, t):
        padded, total, previous, now = [bloom_lm.END, *t], 0.0, {}, {}
        for i in range(1, len(padded)):
            w = padded[i]
            p, own, false = (self.q(0, w) + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)), self.history(w), self.error * self.distinct
            for k in range(1, min(len(self.n), i + 1)):
                history = self.history(padded[i - 1]) if k == 1 else previous[k - 1]
                q = min(self.q(k, tuple(padded[i - k : i + 1])), history, own)
                false = false if k == 1 else self.error * (min(self.history(padded[i - 1]) * len(self.n[1]) / self.tokens, self.distinct) + self.error * self.distinct)
                wrong = false * self.mean[k].get(1, 1)
                if history:
                    p = (q + (self.mass[k] + wrong) * p) / (history + self.mass[k] + 2 * wrong)
                now[k] = own = q
            previous, now = now, {}
            total += math.log10(p)
        return total


@pytest.fixture(scope="module")
def tokens():
    return {i: tokens_of(t) for i, t in duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{SF}/documents.parquet')").fetchall()}


@pytest.mark.parametrize("setting", ["as it is", "several segments and parts, a small head"])
def test_all_rows(spark, tokens, monkeypatch, setting):
    if setting != "as it is":
        monkeypatch.setattr(bloom_lm, "SEGMENT_BYTES", 65_536)
        monkeypatch.setattr(bloom_lm, "PART_BYTES", 20_000)
        monkeypatch.setattr(bloom_lm, "HEAD", 500)
    docs = common.table(spark, SF, "documents")
    got = {r.doc_id: r for r in bloom_lm.held_out_scores(docs).collect()}
    error = bloom_lm.train(docs.where(common.fold_column() != 1)).statistics.error
    held_out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    plain = Plain([t for i, t in tokens.items() if not held_out[i]], head=bloom_lm.HEAD, error=error)
    assert len(got) == len(tokens)
    off = total = 0.0
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out[i], len(t), sum(plain.n[0][w] > 0 for w in t), plain.tokens)
        assert r.base_score == pytest.approx(plain.base(t), rel=1e-9)
        want, wrong = plain.score(t), 3 * error * len(t)  # mistaken ones of three lookups a word; each moves the score by 3 or so
        assert r.score == pytest.approx(want, abs=3 * (wrong + 5 * wrong**0.5 + 2)), i
        off, total = off + abs(r.score - want), total + len(t)
    assert off / total < 20 * error and error < 0.01


@pytest.mark.parametrize("order", [1, 2, 3])
def test_the_formulas_exactly(tokens, monkeypatch, order):
    """With many bits the filter makes no mistakes."""
    monkeypatch.setattr(bloom_lm, "BITS_EACH", 1000)
    texts = {i: " ".join(t[:-1]) for i, t in tokens.items()}
    training = [t for i, t in tokens.items() if i % 3]
    held: dict = {}
    for b in bloom_lm.count_batches([pa.RecordBatch.from_pydict({"text": [t for i, t in texts.items() if i % 3]})], 1, order):
        for r in b.to_pylist():
            held.setdefault(r["order"], []).append(bloom_lm._unpacked(r["order"], r["h"], r["n"]))
    row = bloom_lm._part_row(0, held, order)
    statistics, (h, n) = bloom_lm.summary(np.array(row["grams"]), np.array(row["counts"]), 0.0), bloom_lm._summed(held[1])

    class Sent:
        value = np.frombuffer(row["bits"], np.uint64)

    found = bloom_lm.Filter(bloom_lm.Shape(np.array([0]), np.array([row["lines"]]), np.array([0])), [(0, 0, Sent())])
    plain, scorer = Plain(training, order), bloom_lm.Scorer(statistics, (h, n), found)
    _, sizes, log_p = scorer.look_up(list(texts.values()))
    got = np.add.reduceat(log_p, np.concatenate(([0], np.cumsum(sizes)[:-1])))
    assert got.tolist() == pytest.approx([plain.score(t) for t in tokens.values()], rel=1e-9)


def test_segments_agree(spark, monkeypatch):
    docs = common.table(spark, SF, "documents")
    model = bloom_lm.train(docs)
    assert len(bloom_lm.segments(model)) == 1
    want = {r.doc_id: r.score for r in bloom_lm.score(docs, model).collect()}
    many = model._replace(shape=model.shape._replace(segment=np.arange(len(model.shape.lines))))
    assert len(bloom_lm.segments(many)) > 1
    assert {r.doc_id: r.score for r in bloom_lm.score(docs, many).collect()} == pytest.approx(want)


def test_a_full_vocabulary_starts_anew(spark, monkeypatch, tokens):
    docs = common.table(spark, SF, "documents")
    model = bloom_lm.train(docs)
    plain = Plain(tokens.values())
    found = bloom_lm.Filter(model.shape, bloom_lm.segments(model))
    slices = [[" ".join(t[:-1])] for t in list(tokens.values())[:60]] + [["never1 never2 never3 never4 never5 never6 never7 never8 never9 never10 never11 never12 never13"]]

    def looked_up(known):
        monkeypatch.setattr(bloom_lm, "KNOWN", known)
        scorer = bloom_lm.Scorer(model.statistics, model.head, found)
        out = []
        for texts in slices:
            ids, sizes, log_p = scorer.look_up(texts)
            counts = scorer.count[ids].tolist()
            assert counts == [plain.n[0][w] for w in tokens_of(texts[0])]
            assert len(scorer.count) == len(scorer.p) == len(scorer.history) == len(scorer.vocabulary.hashes)
            out += log_p.tolist()
        return out

    assert looked_up(10) == looked_up(10**6)

    def counted(known):
        monkeypatch.setattr(bloom_lm, "KNOWN", known)
        total = collections.Counter()
        batches = [pa.RecordBatch.from_pydict({"text": t}) for t in slices]
        for b in bloom_lm.count_batches(batches, 7, 3):
            for r in b.to_pylist():
                h, n = bloom_lm._unpacked(r["order"], r["h"], r["n"])
                for x, k in zip(h.tolist(), n.tolist(), strict=True):
                    total[r["part"], r["order"], x] += k
        return total

    assert counted(10) == counted(10**6)
    assert sum(counted(10).values()) == sum(3 * len(tokens_of(t[0])) - 1 for t in slices)


@pytest.mark.parametrize(("order", "off"), [(2, 0.2), (3, 0.35)])
def test_distributions_sum_to_one(spark, order, off):
    sf = "/root/testdata/sf0.01"
    docs = common.table(spark, sf, "documents")
    model = bloom_lm.train(docs, order)
    scorer = bloom_lm.Scorer(model.statistics, model.head, bloom_lm.Filter(model.shape, bloom_lm.segments(model)))
    counts, pairs = collections.Counter(), collections.Counter()
    for (text,) in duckdb.sql(f"SELECT text FROM read_parquet('{sf}/documents.parquet')").fetchall():
        t = tokens_of(text)
        counts.update(t)
        pairs.update(zip(t, t[1:], strict=False))
    words = [w for w in counts if w != bloom_lm.END]
    ids, _, _ = scorer.look_up([" ".join(words)])
    assert scorer.p[ids].sum() + 0.5 / scorer.norm == pytest.approx(1, abs=0.02)

    def total(history):
        texts = [f"{history} {w}" for w in words] + [history]
        _, sizes, log_p = scorer.look_up(texts)
        last = np.cumsum(sizes) - 2  # the word after the history; the end mark for the last text
        last[-1] += 1
        return (10 ** log_p[last]).sum()

    one = [w for w, _ in counts.most_common(1000) if w != bloom_lm.END]
    two = [f"{u} {v}" for (u, v), _ in pairs.most_common(4000) if v != bloom_lm.END]
    for history in (*one[:6], *one[100::300], *two[:3], *two[100::900]):
        assert total(history) == pytest.approx(1, abs=off), history


def test_what_was_seen_once_counts(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "b a d c e")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in bloom_lm.score(docs, bloom_lm.train(docs.where("doc_id = 1"))).collect()}
    assert got[1] == pytest.approx(Plain([tokens_of("a b c d e")]).score(tokens_of("a b c d e")))
    assert got[2] < got[1]


def test_no_training_text(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = bloom_lm.score(docs, bloom_lm.train(docs.where("false"))).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.base_score, r.score) for r in rows] == [(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)]


def test_lookups_never_miss_and_seldom_err():
    rng = np.random.default_rng(4)
    h = np.unique(rng.integers(0, 1 << 63, 200_000).astype(np.uint64) * np.uint64(2))
    n = rng.zipf(1.6, len(h)).clip(max=10**6)
    row = bloom_lm._part_row(0, {1: [(h, n)]}, 1)

    class Sent:
        value = np.frombuffer(row["bits"], np.uint64)

    found = bloom_lm.Filter(bloom_lm.Shape(np.array([0]), np.array([row["lines"]]), np.array([0])), [(0, 0, Sent())])
    level, want = found.levels(h).astype(int), bloom_lm.level_of(n)
    assert (level >= want).all() and (level > want).mean() < 0.03
    assert (found.levels(h + np.uint64(1)) > 0).mean() < 0.02
