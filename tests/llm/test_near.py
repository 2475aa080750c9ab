"""The pipeline's near duplicates against brute force over shingle sets."""

import importlib
import random

import numpy as np
import pytest

from modetrace.llm import near

pipeline = importlib.import_module("corpus_pipeline")


@pytest.mark.parametrize("block", [1024, 3])
def test_near_copies_go_and_others_stay(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rng = random.Random(8)
    texts = [None, "", "one", "ONE", "one two"]
    for k in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((60, 200, 400)))]
        for cuts in range(5):  # up to about 0.6 in similarity
            some = list(words)
            for _ in range(cuts * len(words) // 100):
                some[rng.randrange(len(some))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(some))
    rng.shuffle(texts)

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if 5 * len(x & y) >= 4 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    want = {i for i in range(len(texts)) if find(i) == i}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [r.doc_id for r in pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(got) == sorted(want)


def test_dense_groups_keep_links_few():
    n = 3000
    tile = {"id": np.arange(n), "size": np.full(n, 300)} | {k: np.zeros(n, np.uint64) for k in near.SKETCH}
    assert len(near.forest(tile, None)[0]) == n - 1
    half = {k: v[: n // 2] for k, v in tile.items()}, {k: v[n // 2 :] for k, v in tile.items()}
    assert len(near.forest(*half)[0]) == n - 1


@pytest.mark.parametrize("at_once", [64, 1 << 16])
def test_sets_decide(monkeypatch, at_once):
    monkeypatch.setattr(near, "AT_ONCE", at_once)
    rng = np.random.default_rng(6)
    base, sets = rng.permutation(400)[:120], []
    for _ in range(150):
        x = base.copy()
        k = int(rng.integers(0, 40))
        x[rng.permutation(120)[:k]] = rng.integers(1000, 1300, k)
        sets.append(np.unique(x).astype(np.uint64))
    sets += [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.array([7], np.uint64)]
    for left in (np.ones(len(sets), bool), rng.random(len(sets)) < 0.4):
        labels = np.arange(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if (left.all() or left[i] != left[j]) and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((labels[i], labels[j]))
                    labels[labels == b] = a
        assert near.alike(sets, left).tolist() == labels.tolist()
