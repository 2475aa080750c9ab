"""Repeats from the last point that stays, metrics by time and grouping sets, on hand-made rows."""

import random

from modetrace.config import CANONICAL, EARTH_M  # noqa: F401
from modetrace.operators import analyse, clean, postprocess

POINT = "user_id long, event_id long, t long, lat double, lon double"
RESULT = "user_id long, trip_id string, kind string, seg_id long, mode string, confidence double, " + ", ".join(f"p_{m.lower()} double" for m in CANONICAL) + ", lat double, lon double, t_start long, t_end long"
WINDOWS = "user_id long, blk long, t_start long, t_end long, mode_1 string"
S = 1_000_000
M = 1 / 111_194.926644


def test_slow_drift_stays_in_part(spark):
    """Steps of 4 m each 5 s: neighbour by neighbour all but the first would go."""
    rows = [(1, i, i * 5 * S, 48.5 + i * 4 * M, 2.3) for i in range(30)]
    df = spark.createDataFrame(rows, POINT).repartition(4)
    assert clean.merge_close(df).count() == 1
    assert sorted(r.event_id for r in clean.merge_from_kept(df).collect()) == list(range(0, 30, 3))  # 12 m
    still = spark.createDataFrame([(1, i, i * 5 * S, 48.5, 2.3) for i in range(13)], POINT)
    assert sorted(r.t // S for r in clean.merge_from_kept(still).collect()) == [0, 30, 60]
    assert clean.merge_from_kept(df.where("false")).count() == 0


def test_fold_against_a_loop(spark):
    rng, rows, want = random.Random(3), [], []
    for user in range(4):
        t, y = 0, 48.5
        last = None
        for i in range(200):
            t += rng.choice([0, 1, 5, 10, 29, 30, 31, 300]) * S
            y += rng.choice([-9.13, -3.31, 0, 2.27, 4.71, 9.43, 40]) * M
            rows.append((user, i, t, y, 2.3))
        for r in sorted((r for r in rows if r[0] == user), key=lambda r: (r[2], r[1])):
            if last is None or not (round(abs(r[3] - last[3]) / M, 3) < 10 and r[2] - last[2] < 30 * S):
                last = r
                want.append(r[:2])
    got = clean.merge_from_kept(spark.createDataFrame(rows, POINT).repartition(5))
    assert sorted((r.user_id, r.event_id) for r in got.collect()) == sorted(want)


def predicted(spark, spans, user=1):
    rows = [(user, "D-1-0", "declared", i, m, 0.9, *[0.1] * 7, 48.8, 2.3, a * S, b * S) for i, (m, a, b) in enumerate(spans)]
    return spark.createDataFrame(rows, RESULT)


def test_time_of_pairs(spark):
    """A window of 100 s: 10 s of nothing, 50 s BUS, 20 s WALK, the rest nothing; another window overlaps it."""
    windows = spark.createDataFrame([(1, 0, 0, 100 * S, "BUS"), (1, 1, 50 * S, 120 * S, "WALKING"), (1, 2, 200 * S, 200 * S, "BUS"), (1, 3, 300 * S, 310 * S, "OTHER"), (2, 0, 0, 5 * S, "BUS")], WINDOWS)
    df = predicted(spark, [("BUS", 10, 60), ("WALK", 60, 80), ("CAR", 80, 80), ("WALK", 110, 130), ("BUS", 305, 400)])
    got = {(r.user_id, r.trip_id, r.predicted, r.declared): r.us for r in postprocess.time_by_pair(df, windows).collect()}
    assert got == {
        (1, "D-1-0", None, "BUS"): 30 * S, (1, "D-1-0", "BUS", "BUS"): 50 * S, (1, "D-1-0", "WALK", "BUS"): 20 * S,
        (1, "D-1-1", None, "WALK"): 10 * S - 1, (1, "D-1-1", "WALK", "WALK"): 10 * S,
        (1, "D-1-3", None, None): 5 * S, (1, "D-1-3", "BUS", None): 5 * S, (2, "D-2-0", None, "BUS"): 5 * S,
    }
    rows = {r.trip_id: r for r in postprocess.compare_by_time(df, windows).collect()}
    assert set(rows) == {"D-1-0", "D-1-1"}  # the others have no mode, or no predicted time
    r = rows["D-1-0"]
    assert (r.precision, r.recall) == (50 / 70, 0.5) and abs(r.f1 - 2 * (50 / 70) * 0.5 / (50 / 70 + 0.5)) < 1e-12
    assert rows["D-1-1"].precision == 1.0
    assert postprocess.compare_by_time(df.where("false"), windows).count() == 0


def test_splits_are_those_one_by_one(spark):
    df = predicted(spark, [("BUS", 0, 60), ("WALK", 60, 80)]).union(predicted(spark, [("CAR", 0, 7)], 2)).union(predicted(spark, [("CAR", 0, 9)], 3))
    people = spark.createDataFrame([(1, "F", 17, "x"), (2, None, 18, None)], "user_id long, sex string, age int, diploma string")
    got = sorted((r.by, r.group, r["mode"], r.us, r.pct) for r in analyse.modal_splits(df, people).collect())
    want = sorted((by, r.group, r["mode"], r.us, r.pct) for by in ("sex", "age", "diploma") for r in analyse.modal_split(df, people, by).collect())
    assert got == want
    plan = analyse.modal_splits(df, people)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 4 and "Expand" in plan  # three parts of the union and the people, once
