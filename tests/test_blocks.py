"""Very long traces by blocks of time, against the same steps by user."""

import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from modetrace.config import DEFAULTS
from modetrace.operators import blocks, clean, model, postprocess, segment, trips
from modetrace.operators.features import features
from modetrace.plans.catalog import Tables
from modetrace.sources.scratch import materialise

SF = "/root/testdata/sf0.001"
MINUTES = 60_000_000


def small(minutes):
    return dataclasses.replace(DEFAULTS, block_us=minutes * MINUTES)


def rows_of(df, columns=None):
    return sorted(map(str, df.select(*sorted(columns or df.columns)).collect()))


def hot(spark, seed=5, users=6, n=600):
    """Traces in which user 0 has half of all points, with repeats in time, stops, jumps and pauses."""
    rng, rows = random.Random(seed), []
    for user in range(users):
        t, lat, lon, speed = 0, 48.8, 2.3, 0.0
        for i in range(n * (users - 1) if user == 0 else n):
            t += rng.choice([0, 1, 5, 20, 40, 40, 700]) * 1_000_000 if rng.random() < 0.98 else 9_000_000_000
            if rng.random() < 0.05:
                speed = rng.choice([0, 1, 5, 15, 30])
            lat += speed * 20 / 111_195 * rng.choice([1, 1, -1])
            jump = 0.4 if rng.random() < 0.02 else 0.0
            lat = min(max(lat, 48.1), 48.8)
            rows.append((user, i, t, None if rng.random() < 0.01 else lat + jump, lon))
    points = spark.createDataFrame(rows, "user_id long, event_id long, t long, lat double, lon double")
    windows, last = [], {r[0]: r[2] for r in rows}
    for user, end in last.items():
        start, k = 0, 0
        while start < end:
            length = rng.choice([60, 900, 4000, 30_000]) * 1_000_000
            windows.append((user, k, start, start + length, "BUS"))
            start, k = start + length - rng.choice([0, 0, 50_000_000]) + rng.choice([0, 1000, 20_000]) * 1_000_000, k + 1
    return points, spark.createDataFrame(windows, "user_id long, blk long, t_start long, t_end long, mode_1 string")


@pytest.fixture(scope="module")
def tables(spark):
    out = {s: (Tables(spark, SF, s).points, Tables(spark, SF, s).displacements) for s in ("events", "rides")} | {"hot": hot(spark)}
    return {k: (materialise(p, "points"), materialise(d, "windows")) for k, (p, d) in out.items()}


@pytest.mark.parametrize("source", ["events", "rides", "hot"])
@pytest.mark.parametrize("minutes", [2])
def test_clean_and_trips(tables, source, minutes):
    points, windows = tables[source]
    s = small(minutes)
    plain = clean.clean(points)
    found = materialise(blocks.clean(points, s), "clean")
    assert rows_of(found, plain.columns) == rows_of(plain) != []
    want = trips.trips(plain, windows)
    assert rows_of(blocks.trips(found, windows, s), want.columns) == rows_of(want)


@pytest.mark.parametrize("source", ["events", "rides", "hot"])
@pytest.mark.parametrize("method", ["v1", "v2"])
def test_features(tables, source, method):
    points, windows = tables[source]
    want = features(segment.segments(trips.trips(clean.clean(points), windows), method))
    got = features(blocks.segmented(points, windows, method, small({"v1": 2, "v2": 45}[method])))
    assert rows_of(got, want.columns) == rows_of(want) != []


def test_post(tables):
    points, windows = tables["hot"]
    predicted = materialise(model.rule_predict(features(segment.segments(trips.trips(clean.clean(points), windows)))), "predicted")
    matrix = postprocess.transition_matrix(predicted)
    want = rows_of(postprocess.post_process(predicted, matrix))
    assert rows_of(blocks.transition_matrix(predicted, small(1))) == rows_of(matrix)
    for minutes in (1, 30, 10_000):
        assert rows_of(blocks.post(predicted, matrix, small(minutes))) == want


def test_no_task_holds_a_user(spark, tables):
    """User 0 has half of the points; dealt out as the windows of segments
    deal them, by trip and block, the largest of 40 tasks has a small share."""
    points, windows = tables["hot"]
    total = points.count()
    assert points.where("user_id = 0").count() * 2 == total
    found = blocks.segmented(points, windows, "v1", small(30))
    dealt = found.withColumn("block", F.expr(f"t div {30 * MINUTES}")).repartition(40, "user_id", "trip_id", "block").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in dealt) < total / 10 and len(dealt) == 40
    by_user = points.repartition(40, "user_id").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in by_user) >= total / 2


def test_halo_reaches_over_short_blocks(spark):
    """Blocks of one row: a halo comes from several of them, and stops at the trip's ends."""
    df = spark.createDataFrame([(1, "a", i, 10 * i, i) for i in range(6)] + [(1, "b", 9, 5, 0)], "user_id long, trip_id string, event_id long, t long, block long")
    got = {}
    for r in blocks.with_halo(df, ("user_id", "trip_id"), 3, 2).where("NOT own").collect():
        got.setdefault((r.trip_id, r.block), set()).add(r.event_id)
    assert got == {("a", b): {e for e in range(max(0, b - 3), min(6, b + 3)) if e != b} for b in range(6)}


def test_empty(tables):
    points, windows = tables["hot"]
    assert features(blocks.segmented(points.where("false"), windows, "v1")).count() == 0
    assert blocks.clean(points, small(5)).where("lat IS NULL").count() == 0
