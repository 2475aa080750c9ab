"""Sequence decoding against all sequences of short trips."""

import itertools
import math
import random

import pytest

from modetrace.config import CANONICAL, DEFAULTS
from modetrace.operators.sequence import correct_by_sequence

RESULT = "user_id long, trip_id string, kind string, seg_id long, mode string, confidence double, " + ", ".join(f"p_{m.lower()} double" for m in CANONICAL) + ", lat double, lon double, t_start long, t_end long"


def micro(p):
    x = math.log(max(p or 0.0, DEFAULTS.unseen)) * 1_000_000
    return math.floor(abs(x) + 0.5) * (1 if x > 0 else -1)


def plainly(trip, matrix):
    """The best of all sequences; of equal ones the later names, from the end."""
    options = [[r["mode"]] if r["confidence"] >= DEFAULTS.tau and r["mode"] in CANONICAL else list(CANONICAL) for r in trip]
    best = max(itertools.product(*options), key=lambda q: (sum(micro(r[f"p_{m.lower()}"]) for r, m in zip(trip, q, strict=True)) + sum(micro(matrix.get(x)) for x in zip(q, q[1:], strict=False)), q[::-1]))
    return list(best)


@pytest.fixture(scope="module")
def matrix(spark):
    rng, rows = random.Random(2), {}
    for a in CANONICAL[:5]:  # two modes are never left
        weights = {b: rng.choice([0, 1, 1, 4]) for b in CANONICAL}
        total = sum(weights.values())
        rows |= {(a, b): n / total for b, n in weights.items() if n}
    return rows, spark.createDataFrame([(a, b, 1, p) for (a, b), p in rows.items()], "prev string, next string, n long, p double")


def test_all_sequences(spark, matrix):
    rng, rows, want = random.Random(7), [], {}
    names = [c.split()[0] for c in RESULT.split(", ")]
    for trip in range(60):
        size = rng.randrange(1, 6)
        made = []
        for i in range(size):
            sure = rng.random() < 0.4
            p = [rng.choice([0.0, 0.1, 0.2, 0.2, 0.4]) for _ in CANONICAL]
            made.append(dict(zip(names, (trip % 3, f"D-{trip}", "declared", i, rng.choice(CANONICAL), 0.9 if sure else rng.choice([0.1, 0.5999]), *p, 48.8, 2.3, i // 2, i + 1), strict=True)))
        want[f"D-{trip}"] = plainly(made, matrix[0])
        rows += made
    df = spark.createDataFrame([tuple(r.values()) for r in rows], RESULT).repartition(5)
    got = {}
    for r in sorted(correct_by_sequence(df, matrix[1]).collect(), key=lambda r: (r.t_start, r.seg_id)):
        got.setdefault(r.trip_id, []).append(r["mode"])
    assert got == want
    assert correct_by_sequence(df, matrix[1]).drop("mode").subtract(df.drop("mode")).isEmpty()


def test_long_run_and_edges(spark, matrix):
    """A run of 3000 weak segments, a null confidence, a mode without a name, no rows."""
    rows = [(1, "E-1-0", "extra", i, "BUS", 0.3, *([0.3 if m == CANONICAL[i // 500 % 5] else 0.1 for m in CANONICAL]), 48.8, 2.3, i, i + 1) for i in range(3000)]
    rows += [(2, "D-2-0", "declared", 0, "BUS", None, *[0.1] * 7, 48.8, 2.3, 0, 1), (2, "D-2-1", "declared", 0, "HOVERCRAFT", 0.99, *[None] * 7, 48.8, 2.3, 0, 1)]
    df = spark.createDataFrame(rows, RESULT)
    got = correct_by_sequence(df, matrix[1])
    assert got.count() == 3002 and got.where("mode NOT IN ({})".format(", ".join(f"'{m}'" for m in CANONICAL))).isEmpty()
    assert correct_by_sequence(df.where("false"), matrix[1]).count() == 0
    assert correct_by_sequence(df, matrix[1].where("false")).count() == 3002
