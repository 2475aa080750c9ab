"""Optimal change points against every cut of short profiles and a plain dynamic program."""

import dataclasses
import itertools
import math
import random
import time

import numpy as np
import pytest

from modetrace.config import DEFAULTS
from modetrace.operators import breaks, segment

M = 1 / 111_194.926644


def price(part):
    x = [v for v in part if not math.isnan(v)]
    return float(np.rint(sum(v * v for v in x) - sum(x) * sum(x) / len(x))) if x else 0.0


def total(x, starts, penalty):
    ends = [*starts[1:], len(x)]
    return sum(price(x[a:b]) + penalty for a, b in zip(starts, ends, strict=True))


def test_every_cut():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randrange(1, 10)
        x = [math.nan if rng.random() < 0.1 else float(rng.choice([0, 1000, 1100, 5000, 5200, 9000])) for _ in range(n)]
        penalty = rng.choice([1000, 500_000, 8_000_000])
        cuts = ([0, *c] for k in range(n) for c in itertools.combinations(range(1, n), k))
        best = min(total(x, c, penalty) for c in cuts)
        assert total(x, breaks.partition(np.array(x), penalty), penalty) == best


def test_without_pruning():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x = np.rint(np.repeat(rng.uniform(0, 30_000, 8), rng.integers(1, 40, 8)) + rng.normal(0, 800, 1).item() * 0 + rng.normal(0, 600))
        x = np.rint(x + rng.normal(0, 500, len(x)))
        best, back = [0.0], [0]
        for j in range(1, len(x) + 1):
            options = [(best[i] + price(x[i:j].tolist()), i) for i in range(j)]
            v, i = min(options)
            best.append(v + DEFAULTS.break_penalty)
            back.append(i)
        starts, j = [], len(x)
        while j:
            j = back[j]
            starts.append(j)
        assert breaks.partition(x, DEFAULTS.break_penalty) == starts[::-1]


def test_time_of_a_piece():
    rng = np.random.default_rng(5)
    x = np.rint(np.repeat(rng.uniform(0, 30_000, 100), 41)[:4096] + rng.normal(0, 500, 4096))
    began = time.perf_counter()
    assert len(breaks.partition(x, DEFAULTS.break_penalty)) > 50
    assert time.perf_counter() - began < 3


@pytest.mark.parametrize("size", [4096, 30])
def test_trips_in_pieces(spark, size):
    """Three speeds of 40 points each: two breaks, also where a piece of 30 points ends elsewhere."""
    rows, y = [], 0.0
    for i in range(120):
        y += (2, 12, 5)[i // 40] * 10
        rows.append((1, i, i * 10_000_000, 48.0 + y * M, 2.3, "extra", "E-1-0"))
    rows += [(1, 900 + i, 10**12 + i, 48.8, 2.3, "extra", "E-1-1") for i in range(3)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, t long, lat double, lon double, kind string, trip_id string").repartition(4)
    got = segment.segments(df, "v2", dataclasses.replace(DEFAULTS, break_points=size), optimal=True).orderBy("event_id").collect()
    assert [r.seg_id for r in got] == [0] * 40 + [1] * 40 + [2] * 40 + [0] * 3
    assert segment.segments(df.where("false"), "v2", optimal=True).count() == 0
