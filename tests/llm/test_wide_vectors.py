"""Vectors far from unit length take part, as queries and as candidates."""

import math
import random

import duckdb
import pyarrow as pa

from modetrace.llm import maxscore


def test_every_scale_is_scored_exactly(spark):
    rows = [(0, [1.0, -0.5]), (50, [5000.0, 3.0]), (1, [4096.0, 1.0]), (2, [-1e6, 2.0]), (3, [0.25, 0.25]), (4, [1e6 + 0.5, 1e6]), (5, [1.0, 1.0]), (6, [4095.0, 0.0]), (100, [2.0**21 + 1, 1.0]), (7, [1e7, 0.5]), (50, [5000.0, 3.0]), (50, [0.5, 0.5])]
    v = [(i, [math.floor(256 * c) for c in x]) for i, x in rows]
    want = []
    for at, (q, x) in enumerate(v):
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for other, (i, y) in enumerate(v) if other != at)
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])]
    want.sort()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, maxscore.search_own(df).collect())) == want
    duckdb.register("rows", pa.table({"vec_id": [i for i, _ in rows], "embedding": [x for _, x in rows]}))
    duckdb.sql("CREATE OR REPLACE TEMP VIEW embeddings AS SELECT * FROM rows")
    assert sorted(duckdb.sql(maxscore.ORACLE_SQL).fetchall()) == want
    duckdb.sql("DROP VIEW temp.embeddings")


def test_many_dimensions(spark):
    """20 000 dimensions just below 2^20: sums go beyond what doubles hold exactly."""
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1, 1]) * (4095.0 + rng.random()) for _ in range(20_000)]) for i in range(0, 300, 25)]
    rows.append((7, [(1 << 20) * 1.0 if i == 3 else 0.25 for i in range(19_000)]))
    whole = {i: [math.floor(256 * c) for c in x] for i, x in rows}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = []
    for q in whole:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=False)), i) for i, v in whole.items() if i != q)
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])]
    assert sorted(map(tuple, maxscore.search_own(df).collect())) == sorted(want)


def test_shards_are_bounded_in_numbers():
    lists = pa.array([[0.0] * n for n in (1, 1, 5000, 3, 3)], pa.list_(pa.float64()))
    assert maxscore.shard_rows(lists, 0) == 5 and maxscore.shard_rows(lists, 4) == 1
    assert maxscore.shard_rows(pa.array([[0.0] * 3_000_000] * 3, pa.list_(pa.float64())), 0) == 1
