"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic
function of its words (the word and its prefixes), a document's is the
noisy-or of its sentences', and the weights are learnt from the labels of
documents alone, by gradient descent on the likelihood of the bags. The same
sentence probabilities then locate what offends.

Nothing but the text enters a score. Null and empty texts, and texts without
a word, score 0. Without labels of both classes every score is 0.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, fold_column, labelled_sample, map_text, materialise, text_slices, texts

#: Bound of the sample that the weights are fitted on: documents of each class.
PER_CLASS = 3000
#: Bound of the weights that workers get.
MAX_FEATURES = 20_000
LEAST_DOCUMENTS = 3
PREFIXES = (4, 5, 6)
#: Least chi-square of a feature against the labels of documents.
LEAST_SQUARE = 25.0
STEPS, RATE, DECAY = 200, 0.5, 0.03
#: How many times as many clean documents as toxic ones there are taken to be, at least.
CLEAN_TIMES = 3.0
ENDS = ".!?\n"
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]+")
_MEMO = 150_000


class Model(NamedTuple):
    bias: float
    weights: dict[str, float]


def features(word: str) -> list[str]:
    """The word and, marked with a star, its proper prefixes."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def tokens_of(text: str) -> list[str]:
    """Lower-cased words and sentence ends; empty for a text without a word."""
    found = TOKEN.findall(text.lower())
    return found if any(t[0] not in ENDS for t in found) else []


def features_of(tokens: list[str]) -> set[str]:
    return {f for word in set(tokens) if word[0] not in ENDS for f in features(word)}


class Bag(NamedTuple):
    """A document as its sentences: how many, and where chosen features are."""

    sentences: int
    sentence: np.ndarray
    feature: np.ndarray


def bag_of(tokens: list[str], place: dict[str, int]) -> Bag:
    sentence, of, found = 0, [], []
    for t in tokens:
        if t[0] in ENDS:
            sentence += 1
            continue
        for f in features(t):
            at = place.get(f)
            if at is not None:
                of.append(sentence)
                found.append(at)
    return Bag(sentence + 1, np.array(of, dtype=np.int64), np.array(found, dtype=np.int64))


def chi_square(clean, toxic, n_clean: int, n_toxic: int):
    """Of a feature in so many clean and toxic documents; for numbers, arrays and columns."""
    pooled = (clean + toxic) / (n_clean + n_toxic)
    return (toxic / n_toxic - clean / n_clean) ** 2 / (pooled * (1 - pooled) * (1 / n_clean + 1 / n_toxic) + 1e-12)


def descend(bags: list[Bag], y: np.ndarray, names: list[str]) -> Model:
    """Weights of the features by gradient descent on the likelihood of the bags."""
    starts = np.cumsum([0, *(b.sentences for b in bags)])
    sentence = np.concatenate([b.sentence + at for b, at in zip(bags, starts, strict=False)])
    feature = np.concatenate([b.feature for b in bags])
    owner = np.repeat(np.arange(len(bags)), [b.sentences for b in bags])
    weight = np.concatenate((np.zeros(len(names)), [-4.0]))  # the last is the bias
    # a sample of equal classes would make toxic documents likelier than they are
    balance = np.where(y == 1, 1.0, max(1.0, CLEAN_TIMES * y.sum() / (len(y) - y.sum())))
    balance /= balance.mean()
    power = np.zeros_like(weight)
    for _ in range(STEPS):
        z = np.clip(np.bincount(sentence, weight[feature], len(owner)) + weight[-1], -30, 30)
        p = 1 / (1 + np.exp(-z))
        log_clean = np.bincount(owner, np.log1p(-p), len(y))
        toxic = np.maximum(-np.expm1(log_clean), 1e-9)
        slope = np.where(y == 1, -np.exp(log_clean) / toxic, 1.0) * balance
        g = p * slope[owner] / len(y)
        gradient = np.concatenate((np.bincount(feature, g[sentence], len(names)), [g.sum()]))
        gradient[:-1] += DECAY * weight[:-1] / len(y)
        power += gradient**2
        weight -= RATE * gradient / np.sqrt(power + 1e-16)
    return Model(float(weight[-1]), {f: float(w) for f, w in zip(names, weight, strict=False) if abs(w) > 1e-4})


class Scorer:
    def __init__(self, model: Model):
        self.bias, get = model.bias, model.weights.get

        def weigh(token: str) -> float:
            return np.nan if token[0] in ENDS else sum(get(f, 0.0) for f in features(token))

        self.weights = Memo(weigh, _MEMO)

    def sentences(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The probability of each sentence, and each token's sentence."""
        w = np.fromiter(map(self.weights.__getitem__, tokens), dtype=float, count=len(tokens))
        ends = np.isnan(w)
        of = np.cumsum(ends)
        w[ends] = 0.0
        count = int(of[-1]) + 1
        has = np.bincount(of, ~ends, count) > 0
        z = np.clip(np.bincount(of, w, count) + self.bias, -30, 30)
        return np.where(has, 1 / (1 + np.exp(-z)), 0.0), of

    def score(self, text: str) -> float:
        tokens = TOKEN.findall(text.lower())
        if not tokens:
            return 0.0
        p, _ = self.sentences(tokens)
        return float(-np.expm1(np.log1p(-p).sum()))

    def locate(self, text: str, least: float) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences of at least that probability."""
        lower = text.lower()
        found = list(TOKEN.finditer(lower))
        if not found or len(lower) != len(text):  # offsets must be the source's
            found = list(TOKEN.finditer(text))
        if not found:
            return []
        p, of = self.sentences([m.group().lower() for m in found])
        out, order = [], np.argsort(of, kind="stable")
        for i in np.flatnonzero(p >= least):
            at = order[slice(*np.searchsorted(of, (i, i + 1), sorter=order))]
            inner = [k for k in at if found[k].group()[0] not in ENDS]
            out.append((found[inner[0]].start(), found[inner[-1]].end(), float(p[i])))
        return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learn from at most ``per_class`` labelled documents of each class, none
    of them of the held-out fold; a copied text counts once, for its least id.

    Workers count features by class, and then send where the chosen ones are: the
    driver gets their names, MAX_FEATURES at most, and no texts.
    """
    first = Window.partitionBy(F.xxhash64(F.lower(F.coalesce("text", F.lit(""))))).orderBy("doc_id", "label")
    sample = labelled_sample(docs, labels, "toxic", per_class).withColumn("copy", F.row_number().over(first)).where("copy = 1").select("label", "text")
    sample = materialise(sample, "toxic-sample")

    def count(batches):
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, label in zip(texts(batch), batch.column("label").to_pylist(), strict=True):
                tokens = tokens_of(text)
                for f in features_of(tokens):
                    seen.setdefault(f, [0, 0])[label] += 1
                if tokens:
                    seen.setdefault("", [0, 0])[label] += 1  # the documents themselves
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in (0, 1))], ["feature", "clean", "toxic"])

    seen = sample.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    seen = materialise(seen, "toxic-features")
    all_ = seen.where("feature = ''").first()
    if all_ is None or not all_.clean or not all_.toxic:
        return Model(-30.0, {})
    # keep features whose rates differ by more than chance among so many would make them
    scored = seen.where((F.col("feature") != "") & (F.col("clean") + F.col("toxic") >= LEAST_DOCUMENTS)).withColumn("square", chi_square(F.col("clean"), F.col("toxic"), all_.clean, all_.toxic))
    names = sorted(r.feature for r in scored.where(F.col("square") > LEAST_SQUARE).orderBy(F.desc("square"), "feature").limit(MAX_FEATURES).select("feature").collect())
    place = {f: i for i, f in enumerate(names)}

    def find(batches):
        for batch in batches:
            for part in text_slices(batch):
                rows = [(bag_of(tokens, place), label) for tokens, label in zip(map(tokens_of, texts(part)), part.column("label").to_pylist(), strict=True) if tokens]
                yield pa.RecordBatch.from_pydict({"label": [y for _, y in rows], "sentences": [b.sentences for b, _ in rows], "sentence": [b.sentence.tolist() for b, _ in rows], "feature": [b.feature.tolist() for b, _ in rows]}, schema=schema)

    schema = pa.schema([("label", pa.int32()), ("sentences", pa.int64()), ("sentence", pa.list_(pa.int64())), ("feature", pa.list_(pa.int64()))])
    found = sample.mapInArrow(find, "label int, sentences long, sentence array<long>, feature array<long>").collect()
    found.sort(key=lambda r: (r.label, r.sentences, r.sentence, r.feature))
    return descend([Bag(r.sentences, np.array(r.sentence, dtype=np.int64), np.array(r.feature, dtype=np.int64)) for r in found], np.array([r.label for r in found], dtype=float), names)


def score(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, score, sentences) of every text; ``sentences`` are the offending
    ones, of that probability or more, as code point ranges with their
    probabilities. An empty array where there is none."""

    def make():
        scorer = Scorer(model)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

        def work(b):
            found = texts(b)
            scores = [scorer.score(t) for t in found]
            # a document is at least as toxic as each of its sentences
            where = [[{"start": a, "end": z, "probability": p} for a, z, p in scorer.locate(t, least)] if s >= least else [] for t, s in zip(found, scores, strict=True)]
            return {"doc_id": b.column("doc_id").cast(pa.int64()), "score": scores, "sentences": pa.array(where, kind)}

        return work

    return map_text(docs, ["doc_id", "text"], "doc_id long, score double, sentences array<struct<start:long,end:long,probability:double>>", make)


def verdicts(scores: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and the offending sentences as
    start:end, comma-joined."""
    joined = F.array_join(F.transform("sentences", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scores.select("doc_id", (fold_column() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), joined.alias("offending"))
