"""Steps whose work must not grow faster than their input."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from modetrace.config import DEFAULTS, EARTH_M
from modetrace.functions import graph
from modetrace.functions.grouped import whole_groups
from modetrace.operators import blocks, breaks, optics, postprocess, segment, trips
from modetrace.plans.catalog import Tables
from modetrace.sources import deal

S = 1_000_000


def test_many_short_pieces_take_little_time(spark):
    """60 000 pieces of one point and a stay: each piece was a call of Python before."""
    lone = spark.range(60_000).select(F.expr("id div 600").alias("user_id"), "id", (F.col("id") * 60 * S).alias("t"), (F.lit(48.1) + (F.col("id") % 100) * 0.01).alias("lat"), F.lit(2.3).alias("lon")).withColumnRenamed("id", "event_id")
    stay = spark.range(30).select(F.lit(500).cast("long").alias("user_id"), F.col("id").alias("event_id"), (F.col("id") * 60 * S).alias("t"), F.lit(48.8).alias("lat"), F.lit(2.3).alias("lon"))
    began = time.perf_counter()
    rows = trips.stay_points(lone.unionByName(stay)).groupBy("stay").count().collect()
    assert {r.stay: r["count"] for r in rows} == {False: 60_000, True: 30}
    assert time.perf_counter() - began < 15


def test_groups_across_batches():
    starts = [True, False, False, True, True, False, False, False, False, True]
    rows = pa.RecordBatch.from_pydict({"x": list(range(10)), "starts": starts})
    for size in (1, 2, 3, 4, 10):
        tables = list(whole_groups((rows.slice(i, size) for i in range(0, 10, size)), "starts"))
        assert [x for t in tables for x in t.column("x").to_pylist()] == list(range(10))
        assert all(t.column("starts").to_pylist()[0] for t in tables)
    assert list(whole_groups(iter([rows.slice(0, 0)]), "starts")) == []


SF = "/root/testdata/sf0.001"


def test_tasks_follow_rows(spark, monkeypatch):
    """Points, trips, predictions and marks are dealt out by rows; Spark put them together
    by their compressed size, so that a task's sorts grew with the table."""
    plain = Tables(spark, SF, "rides")
    want = {n: sorted(map(str, f.collect())) for n, f in (("changes", plain.changes()), ("pairs", postprocess.time_by_pair(plain.post(), plain.displacements)))}
    monkeypatch.setattr(deal, "ROWS_A_TASK", 300)
    t = Tables(spark, SF, "rides")
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert t.tasks == -(-rows // 300) > 10
    pairs = postprocess.time_by_pair(t.post(), t.displacements, t.tasks)
    assert t.points.rdd.getNumPartitions() == t.trips().rdd.getNumPartitions() == t.tasks
    monkeypatch.setattr(deal, "ROWS_A_TASK", 40)
    assert t.changes().rdd.getNumPartitions() == -(-t.predicted().count() // 40) > 4
    assert {"changes": sorted(map(str, t.changes().collect())), "pairs": sorted(map(str, pairs.collect()))} == want


def test_profiles_side_by_side(monkeypatch):
    """The same cuts as one by one, with missing speeds and several lengths."""
    rng = np.random.default_rng(8)
    profiles = [np.rint(np.repeat(rng.uniform(0, 30_000, 9), rng.integers(1, 30, 9)) + 0.0) for _ in range(60)]
    profiles = [np.where(rng.random(len(x)) < 0.1, np.nan, np.rint(x + rng.normal(0, 2000, len(x)))) for x in profiles] + [np.array([np.nan]), np.array([5.0])]
    monkeypatch.setattr(breaks, "SHORT", 150)
    got = breaks.partitions(profiles, DEFAULTS.break_penalty)
    assert [p.tolist() for p in got] == [breaks.partition(x, DEFAULTS.break_penalty) for x in profiles]


def test_many_trips_take_little_time(spark):
    """4000 trips of 60 points: each was a call of Python, and each point a dozen of numpy, before."""
    df = spark.range(240_000).select(F.expr("id div 6000").alias("user_id"), F.col("id").alias("event_id"), (F.col("id") * 10 * S).alias("t"), (F.lit(48.1) + (F.col("id") % 60) * 0.001 * (1 + (F.col("id") % 60 > 30).cast("int"))).alias("lat"), F.lit(2.3).alias("lon"), F.lit("extra").alias("kind"), F.expr("concat('E-', id div 60)").alias("trip_id"))
    began = time.perf_counter()
    rows = segment.segments(df, "v2", optimal=True).groupBy("seg_id").count().collect()
    assert sum(r["count"] for r in rows) == 240_000 and len(rows) > 1
    assert time.perf_counter() - began < 12


def test_blocks_are_dealt_by_rows(spark, monkeypatch):
    """Long traces too: the segments of their blocks lie in as many tasks as the rows ask for."""
    t = Tables(spark, SF, "rides")
    want = sorted(map(str, blocks.segmented(t.points, t.displacements).collect()))
    monkeypatch.setattr(deal, "ROWS_A_TASK", 300)
    t = Tables(spark, SF, "rides")
    got = blocks.segmented(t.points, t.displacements, tasks=t.tasks)
    assert got.rdd.getNumPartitions() == t.tasks > 10
    assert sorted(map(str, got.collect())) == want


def test_few_edges_a_place(spark):
    """A full square of places: a forest looked at every pair within reach before."""
    places = [(y, x) for y in range(97_000, 97_012) for x in range(4_000, 4_012)]
    name = {p: p[0] * (1 << 32) + p[1] for p in places}
    near = [(name[a], name[b], round(55.6 * ((a[0] - b[0]) ** 2 + (0.66 * (a[1] - b[1])) ** 2) ** 0.5, 3)) for a in places for b in places]
    pairs = spark.createDataFrame([r for r in near if r[2] <= 400], "node long, other long, metres double")
    cores = spark.createDataFrame([(n, 0.0) for n in name.values()], "node long, core double")
    assert pairs.count() > 50 * len(places)
    assert optics.short_edges(pairs, cores).count() <= 8 * len(places)


def test_long_chain_takes_few_jobs(spark):
    """100 places in a row: finding a cluster took rounds in proportion to its length before, 949 jobs."""
    chain = [(97_400 + i, 4_700) for i in range(100)] + [(97_700, 4_700)]
    rows = [(3 * i + j, f"E-{i}-0", j, i, (y + 0.5) / DEFAULTS.cluster_cells, (x + 0.5) / DEFAULTS.cluster_cells) for i, (y, x) in enumerate(chain) for j in range(3)]
    changes = spark.createDataFrame(rows, "user_id long, trip_id string, seg_id long, t long, lat double, lon double")
    spark.sparkContext.setJobGroup("chain", "")
    try:
        found = {(r.radius, r.lat_cell): r.cluster for r in optics.clusters_at(changes, (30.0, 60.0, 450.0)).collect()}
    finally:
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
        spark.sparkContext._jsc.clearJobGroup()
    name = {y: y * (1 << 32) + x for y, x in chain}
    assert found == {(r, y): name[y] if r == 30 or y == 97_700 else name[97_400] for r in (30.0, 60.0, 450.0) for y in name}
    assert 0 < jobs < 100


def test_rounds_and_one_task_agree(spark, monkeypatch):
    """Boruvka rounds down to few edges, and all in one task: the same forest, and the components of a plain search."""
    rng = np.random.default_rng(5)
    ends = [tuple(map(int, e)) for e in rng.integers(0, 900, (700, 2))] + [(1000 + i, 1001 + i) for i in range(300)] + [(2000, 2001 + i) for i in range(99)] + [(2300, 2201 + i) for i in range(99)]
    rows = [(*(e[::-1] if i % 3 else e), float(rng.integers(1, 9))) for i, e in enumerate(ends)] + [(1, 2, 3.0), (2, 1, 3.0), (1, 2, 0.5)]
    edges = spark.createDataFrame(rows, "u long, v long, weight double")
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    kept = []
    for w, u, v in sorted((w, min(u, v), max(u, v)) for u, v, w in rows if u != v):
        if find(u) != find(v):
            top[find(u)] = find(v)
            kept.append((u, v, w))
    tables = []
    materialise = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, purpose: tables.append(purpose) or materialise(df, purpose))
    for few, rounds in ((250_000, 0), (60, 2)):
        monkeypatch.setattr(deal, "ROWS_A_TASK", few)
        assert sorted(map(tuple, graph.least_forest(edges).collect())) == sorted(kept)
        tables.clear()
        got = {r.node: r.root for r in graph.components(edges).collect()}
        assert tables.count("least") >= rounds and len(tables) < 50
        assert set(got) == set(top)
        assert len({(got[x], find(x)) for x in got}) == len(set(got.values())) == len({find(x) for x in got})
        assert all(got[root] == root for root in got.values())


def test_crowded_neighbours(spark, monkeypatch):
    """3000 points within 25 m and some far off: 9 million pairs of one task before; the same as brute force,
    with the queries of a busy cell in several tasks."""
    rng = np.random.default_rng(3)
    at = np.concatenate([np.round([48.85, 2.35] + rng.random((3000, 2)) * 0.0002, 6), np.round([48.2, 2.0] + rng.random((30, 2)), 6)])
    df = spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in enumerate(at)], "id long, lat double, lon double")
    sites = df.select(F.struct("id").alias("near"), F.col("lat").alias("lat_2"), F.col("lon").alias("lon_2"))
    assert optics.first_side(df, sites) < 2 and optics.first_side(df.where("id >= 3000"), sites.where("near.id >= 3000")) == DEFAULTS.nearest_cell_m
    monkeypatch.setattr(deal, "ROWS_A_TASK", 10_000)
    got = {(r.id, r["rank"]): (r.metres, r.near_id) for r in optics.nearest(df, df, ("id",), 3).collect()}
    assert len(got) == 3 * len(at)
    y, x = np.radians(at).T
    for i in (*range(0, 3000, 20), *range(3000, 3030)):
        h = np.sin((y - y[i]) / 2) ** 2 + np.cos(y[i]) * np.cos(y) * np.sin((x - x[i]) / 2) ** 2
        m = np.round(2 * EARTH_M * np.arcsin(np.sqrt(h)), 3)
        want = sorted((float(m[j]), int(j)) for j in np.argpartition(m, 40)[:40] if j != i)[:3]
        assert [got[i, n] for n in (1, 2, 3)] == want
