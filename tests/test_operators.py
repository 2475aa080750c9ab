"""Hand-made rows at the boundaries of each operator."""

import collections
import math
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modetrace.functions.graph import connected
from modetrace.config import CANONICAL, MODE_MAP, Settings
from modetrace.operators import analyse, clean, labels, model, postprocess, segment, spatial, trips
from modetrace.operators.features import features

POINT = "user_id long, event_id long, t long, lat double, lon double"
RESULT = "user_id long, trip_id string, kind string, seg_id long, mode string, confidence double, " + ", ".join(f"p_{m.lower()} double" for m in CANONICAL) + ", lat double, lon double, t_start long, t_end long"
S = 1_000_000
M = 1 / 111_194.926644  # a metre of latitude in degrees


def points(spark, rows):
    """(t in seconds, metres north) of user 1."""
    return spark.createDataFrame([(1, i, int(t * S), 48.8 + y * M, 2.3) for i, (t, y) in enumerate(rows)], POINT)


def predicted(spark, modes, confidence=0.9, trip="D-1-0", probabilities=None, kind="declared"):
    rows = []
    for i, m in enumerate(modes):
        p = probabilities or {m: confidence}
        rows.append((1, trip, kind, i, m, confidence, *(p.get(c, 0.0) for c in CANONICAL), 48.8, 2.3, i * S, (i + 1) * S))
    return spark.createDataFrame(rows, RESULT)


def modes(df):
    return [r.mode for r in df.orderBy("trip_id", "seg_id").collect()]


def test_missing_and_range(spark):
    rows = [(1, 1, 0, math.nan, 2.3), (1, 2, 1, None, 2.3), (1, 3, 2, 48.0, 3.6), (1, 4, 3, 91.0, 2.3), (1, 5, 4, 47.999, 2.3)]
    df = spark.createDataFrame(rows, POINT)
    assert [r.event_id for r in clean.drop_missing(df).orderBy("event_id").collect()] == [3, 4, 5]
    assert [r.event_id for r in clean.in_region(clean.in_range(clean.drop_missing(df))).collect()] == [3]


def test_merge_is_strict(spark):
    near = points(spark, [(0, 0), (29, 9.9), (59, 19.8), (60, 29.9)])  # 30 s apart stays; 10.1 m stays
    assert [r.event_id for r in clean.merge_close(near).orderBy("event_id").collect()] == [0, 2, 3]


def test_spike_needs_both_sides(spark):
    assert clean.drop_spikes(points(spark, [(0, 0), (1, 100), (2, 0)])).count() == 2
    assert clean.drop_spikes(points(spark, [(0, 0), (1, 100), (10, 100)])).count() == 3


def test_same_time_has_no_speed(spark):
    from modetrace.functions.motion import with_motion

    assert [r.v for r in with_motion(points(spark, [(0, 0), (0, 5), (2, 9)]), "user_id").orderBy("event_id").collect()][:2] == [None, None]


def test_gap_of_ten_minutes_stays(spark):
    df = trips.gap_trips(points(spark, [(0, 0), (600, 0), (1200.000001, 0)]))
    assert [r.n for r in df.orderBy("event_id").collect()] == [0, 0, 1]


def test_earliest_window_wins(spark):
    windows = spark.createDataFrame([(1, 5, 0, 10 * S, "BUS"), (1, 4, 5 * S, 20 * S, "BUS")], "user_id long, blk long, t_start long, t_end long, mode_1 string")
    df = points(spark, [(0, 0), (7, 0), (20, 0), (21, 0)])
    assert [(r.event_id, r.blk) for r in trips.declared_points(df, windows).orderBy("event_id").collect()] == [(0, 5), (1, 5), (2, 4)]
    assert [r.event_id for r in trips.extra_points(df, windows).collect()] == [3]


def test_stay(spark):
    rows = [(0, 0), (100, 900)] + [(200 + 300 * i, 1000 + i) for i in range(6)] + [(2000, 3000)]
    found = trips.stay_points(points(spark, rows)).orderBy("event_id").collect()
    assert [r.stay for r in found] == [False] + [True] * 7 + [False]
    none = spark.createDataFrame([], "user_id long, blk long, t_start long, t_end long, mode_1 string")
    cut = trips.trips(points(spark, rows), none, stays=True).orderBy("event_id").collect()
    assert [r.trip_id for r in cut] == ["E-1-0"] * 8 + ["E-1-1"]
    assert {r.trip_id for r in trips.trips(points(spark, rows), none).collect()} == {"E-1-0"}


def one_trip(spark, rows):

    return points(spark, rows).withColumn("kind", F.lit("extra")).withColumn("trip_id", F.lit("E-1-0"))


def test_labels_and_runs(spark):
    df = one_trip(spark, [(0, 0), (10, 10), (20, 20), (30, 300), (40, 600), (50, 610)])
    rows = segment.runs(segment.label_points(df)).orderBy("event_id").collect()
    assert [r.label for r in rows][:4] == ["walk", "walk", "walk", "other"]
    assert rows[0].run == 0 and rows[3].run == 1


def test_lone_point(spark):
    row = features(segment.segments(one_trip(spark, [(0, 0)]))).first()
    assert row.length_m == 0.0 and row.v_max is None and row.hcr is None and row.n_points == 1


def test_methods(spark):
    df = one_trip(spark, [(0, 0), (10, 10), (20, 20), (30, 300)])
    assert segment.segments(df, "v2").select("seg_id").distinct().count() >= 2
    assert segment.segments(df, "v1", merge=True).count() == 4
    with pytest.raises(ValueError, match="method"):
        segment.segments(df, "v3")
    with pytest.raises(ValueError, match="not in index"):
        model.check_features(df, "v1")


def test_modes_map(spark):
    names = [*MODE_MAP, "OTHER", "metro", "taxi", "walk", None]
    df = spark.createDataFrame([(n,) for n in names], "m string").select(labels.canonical(F.col("m")).alias("c"))
    got = [r.c for r in df.collect()]
    assert got == [*MODE_MAP.values(), None, "SUBWAY", "CAR", "WALK", None]


def test_split_is_disjoint_and_covers(spark):
    users = spark.range(57).withColumnRenamed("id", "user_id")
    rows = labels.split_users(users).collect()
    assert len(rows) == 57 and sum(r.split == "train" for r in rows) == 39


def test_matrix_rows_sum_to_one(spark):
    m = postprocess.transition_matrix(predicted(spark, ["BUS", "CAR", "BUS", "BUS", "WALK"])).collect()
    total = {}
    for r in m:
        total[r.prev] = total.get(r.prev, 0) + r.p
    assert all(abs(v - 1) < 1e-12 for v in total.values())


def test_weak_prediction_follows_transitions(spark):
    matrix = spark.createDataFrame([("BUS", "WALK", 9, 0.9), ("BUS", "CAR", 1, 0.1)], "prev string, next string, n long, p double")
    df = predicted(spark, ["BUS", "CAR"], 0.5, probabilities={"CAR": 0.5, "WALK": 0.4})
    assert modes(postprocess.correct_by_transitions(df, matrix)) == ["BUS", "WALK"]
    assert modes(postprocess.correct_by_transitions(predicted(spark, ["BUS", "CAR"], 0.6), matrix)) == ["BUS", "CAR"]


def test_vote_ties_and_trips(spark):
    assert modes(postprocess.sliding_majority_vote(predicted(spark, ["CAR", "BUS", "CAR", "BUS", "WALK"])))[2] == "BUS"
    two = predicted(spark, ["CAR", "CAR"]).union(predicted(spark, ["BUS"], trip="D-1-1"))
    assert modes(postprocess.sliding_majority_vote(two)) == ["CAR", "CAR", "BUS"]


def test_fusion_is_at_once_and_within_trips(spark):
    assert modes(postprocess.fusion_segments(predicted(spark, ["BUS", "CAR", "BUS", "CAR"]))) == ["BUS", "BUS", "CAR", "CAR"]
    two = predicted(spark, ["BUS", "CAR"]).union(predicted(spark, ["BUS"], trip="D-1-1"))
    assert modes(postprocess.fusion_segments(two)) == ["BUS", "CAR", "BUS"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(CANONICAL), min_size=1, max_size=9))
def test_vote_stays_within_its_window(spark, names):
    got = modes(postprocess.sliding_majority_vote(predicted(spark, names)))
    assert all(m in names[max(0, i - 2) : i + 3] for i, m in enumerate(got))
    once = postprocess.normalise_names(predicted(spark, names))
    assert modes(postprocess.normalise_names(once)) == modes(once)


def test_metrics_and_trip_tables(spark):
    shown = spark.createDataFrame([(1, 0, 0, 9 * S, "BUS"), (1, 1, 0, 9 * S, "OTHER")], "user_id long, blk long, t_start long, t_end long, mode_1 string")
    df = predicted(spark, ["BUS", "CAR"]).union(predicted(spark, ["CAR"], trip="D-1-1")).union(predicted(spark, ["WALK"], trip="E-1-0", kind="extra"))
    rows = {r.trip_id: r for r in analyse.all_trips(df, shown).collect()}
    assert (rows["D-1-0"].precision, rows["D-1-0"].recall) == (0.5, 1.0) and abs(rows["D-1-0"].f1 - 2 / 3) < 1e-12
    assert rows["D-1-0"].predicted == "BUS|CAR" and rows["D-1-1"].precision is None and rows["E-1-0"].declared is None
    changes = analyse.change_points(df)
    assert [(r.prev, r.mode) for r in changes.collect()] == [("BUS", "CAR")]
    assert analyse.observed_matrix(changes).first().to_car == 1
    assert analyse.change_density(changes).first().n == 1
    assert sum(r.pct for r in postprocess.time_per_mode(df).collect()) == pytest.approx(100)


CHANGE = "user_id long, trip_id string, seg_id long, t long, lat double, lon double, prev string, mode string"


def test_clusters_by_brute_force(spark):
    """Density clusters over a wide area, across all borders of cells."""
    rng = random.Random(3)
    spots = [(48.7 + rng.random() * 0.05, 2.3 + rng.random() * 0.05) for _ in range(25)]
    places = [(la + rng.gauss(0, 0.0012), lo + rng.gauss(0, 0.0018)) for la, lo in spots for _ in range(12)]
    places += [(48.75 + i * 0.0016, 2.349) for i in range(40) for _ in range(2)]  # a line some cells long, of one cluster
    changes = spark.createDataFrame([(1, "E-1-0", i, i, la, lo, "BUS", "CAR") for i, (la, lo) in enumerate(places)], CHANGE)
    s = Settings()
    cells = collections.Counter((math.floor(la * s.cluster_cells), math.floor(lo * s.cluster_cells)) for la, lo in places)

    def metres(a, b):
        (la, lo), (lb, mb) = (((y + 0.5) / s.cluster_cells, (x + 0.5) / s.cluster_cells) for y, x in (a, b))
        h = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(mb - lo) / 2) ** 2
        return round(2 * 6_371_000 * math.asin(math.sqrt(min(1, h))), 3)

    near = {a: [b for b in cells if metres(a, b) <= s.radius_m] for a in cells}
    cores = {a for a in cells if sum(cells[b] for b in near[a]) >= s.dense}
    name = {}
    for a in sorted(cores):
        if a not in name:
            todo = [a]
            while todo:
                b = todo.pop()
                if b not in name:
                    name[b] = a
                    todo += [c for c in near[b] if c in cores]
    want = {}
    for a in cells:
        best = min(((metres(a, b), name[b]) for b in near[a] if b in cores), default=(0, None))[1]
        want[a] = -1 if best is None else best[0] * (1 << 32) + best[1]
    got = {(r.lat_cell, r.lon_cell): r.cluster for r in spatial.clusters(changes).collect()}
    assert got == want and len({c for c in want.values() if c >= 0}) > 5 and -1 in want.values()


def test_stays_by_brute_force(spark):
    rng, s = random.Random(9), Settings()
    rows = []
    for user in range(6):
        t, y = 0, 0.0
        for i in range(300):
            t += rng.choice((20, 60, 200))
            y += rng.choice((0, 3, 30, -40, 150, 450) if (i // 40) % 2 else (0, 1, -1, 5))
            rows.append((user, i, t * S, 48.8 + y * M, 2.3))
    got = {(r.user_id, r.event_id): r.stay for r in trips.stay_points(spark.createDataFrame(rows, POINT)).collect()}
    for user in range(6):
        mine = [r for r in rows if r[0] == user]
        want, i = [False] * len(mine), 0
        while i < len(mine):
            j = i + 1
            while j < len(mine) and round(abs(mine[j][3] - mine[i][3]) / M, 3) <= s.stay_m:
                j += 1
            if mine[j - 1][2] - mine[i][2] >= s.stay_s * S:
                want[i:j] = [True] * (j - i)
                i = j
            else:
                i += 1
        assert [got[user, r[1]] for r in mine] == want and any(want) and not all(want)


def test_overlapping_windows_by_brute_force(spark):
    rng = random.Random(4)
    rows = [(u, i, rng.randrange(200), 48.8, 2.3) for u in range(5) for i in range(80)]
    windows = [(u, b, a := rng.randrange(200), a + rng.randrange(40), "BUS") for u in range(5) for b in range(12)]
    shown = spark.createDataFrame(windows, "user_id long, blk long, t_start long, t_end long, mode_1 string")
    got = {(r.user_id, r.event_id): r.blk for r in trips.with_windows(spark.createDataFrame(rows, POINT), shown).collect()}
    for u, i, t, _, _ in rows:
        inside = sorted((a, b) for w, b, a, z, _ in windows if w == u and a <= t <= z)
        assert got[u, i] == (inside[0][1] if inside else None)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(got) == {x for e in edges if e[0] != e[1] for x in e}
    assert len({(got[x], find(x)) for x in got}) == len(set(got.values())) == len({find(x) for x in got})


def test_radius_and_clusters(spark):
    rows = [(1, "E-1-0", i, i, 48.81 + y * M, 2.3, "BUS", "CAR") for i, y in enumerate((0, 100, 220, 5000, 5000))]
    changes = spark.createDataFrame(rows, CHANGE)
    assert [r.n for r in spatial.radius_counts(changes).orderBy("seg_id").collect()] == [1, 2, 1, 1, 1]
    found = spatial.clusters(changes).orderBy("lat_cell").collect()
    assert [r.cluster >= 0 for r in found] == [True, True, True, False]
    weak = predicted(spark, ["BUS"], 0.4, probabilities={"BUS": 0.4, "CAR": 0.3}).withColumn("lat", F.lit(48.81))
    assert modes(spatial.spatial_post_process(weak, changes)) == ["CAR"]


@pytest.mark.parametrize(("radius", "finer", "refined"), [(200.0, 4, 2), (35.0, 2, 3), (90.0, 4, 0), (5.0, 4, 1)])
def test_radius_counts_are_exact(spark, radius, finer, refined):
    rng = random.Random(int(radius))
    places = [(48.81 + rng.gauss(0, 90) * M, 2.3 + rng.gauss(0, 130) * M) for _ in range(250)]
    places += [(48.81 + radius * M, 2.3), (48.81 - radius * M, 2.3)] + [(48.81, 2.3)] * 40 + [(48.9, 2.4)]
    rows = [(1, "E-1-0", i, i, y, x, "BUS", "CAR") for i, (y, x) in enumerate(places)]
    changes = spark.createDataFrame(rows + [(1, "E-1-0", 999, 0, None, 2.3, "BUS", "CAR")], CHANGE)
    got = {r.seg_id: r.n for r in spatial.radius_counts(changes, Settings(radius_m=radius, finer=finer, refined=refined)).collect()}

    def metres(a, b):
        h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return round(2 * 6_371_000 * math.asin(math.sqrt(h)), 3)

    assert got == {i: sum(metres(a, b) <= radius for b in places) - 1 for i, a in enumerate(places)}
    assert spatial.radius_counts(changes.limit(0)).count() == 0


def test_forest_roundtrip(spark, tmp_path):

    from modetrace.sources import readers, writers

    rows = [(u, f"D-{u}-0", 0, "declared", 0.0 if u % 2 else 0.01, 0.0, 0.0, 20.0 if u % 2 else 1.0, 0.1, 1.0, 1.0, 0.0, 0.0, 10, 5.0, 48.8, 2.3, 0, 10, 5, "CAR" if u % 2 else "WALK") for u in range(60)]
    names = "user_id long, trip_id string, seg_id long, kind string, hcr double, sr double, vcr double, v_max double, a_max double, v_median double, v_p99 double, share_fast double, share_very_fast double, duration_us long, length_m double, lat double, lon double, t_start long, t_end long, n_points long, mode string"
    df = spark.createDataFrame(rows, names)
    s = Settings(trees=5)
    writers.model(model.fit(df, "v2", s), str(tmp_path / "m"))
    got = model.predict(df, writers.load_model(str(tmp_path / "m")), "v2").join(df.select("user_id", F.col("mode").alias("truth")), "user_id")
    assert got.where("mode <> truth").count() == 0
    total = sum(F.col(f"p_{m.lower()}") for m in CANONICAL)
    assert got.where(F.abs(total - 1) > 1e-9).count() == 0
    writers.training(df.select("user_id", "trip_id", "seg_id", "hcr", "sr", "vcr", "v_max", "a_max", "mode"), str(tmp_path / "t"), "v2")
    assert readers.training(spark, str(tmp_path / "t"), "v2").count() == 60
    with pytest.raises(ValueError, match="not in index"):
        model.fit(readers.training(spark, str(tmp_path / "t"), "v2"), "v1", s)


def test_whole_run(spark, tmp_path):
    from modetrace.plans import pipeline
    from modetrace.sources import fixture, readers, writers

    sf, out, s = "/root/testdata/sf0.001", str(tmp_path), Settings(trees=5, depth=4)
    gps, shown, people = (f(spark, sf) for f in (lambda x, d: fixture.gps_points(x, d, "rides"), lambda x, d: fixture.displacements(x, d, "rides"), fixture.individuals))
    pipeline.train(gps, shown, out, "v1", s)
    table = pipeline.analyse_all(spark, gps, shown, people, out, "v1", s)
    want = {r.trip_id: r for r in table.collect()}
    back = {r.trip_id: r for r in spark.read.option("header", True).csv(f"{out}/trajets_par_utilisateur.csv").collect()}
    assert want and set(back) == set(want)
    for k, r in want.items():
        assert (int(back[k].user_id), back[k].kind, back[k].date, int(back[k].hour), back[k].predicted, back[k].declared) == (r.user_id, r.kind, r.date, r.hour, r.predicted, r.declared)
        assert r.f1 is None or float(back[k].f1) == pytest.approx(r.f1)
    changes = spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/points_changement.csv").collect()
    assert all({"user_id", "trip_id", "seg_id", "t", "lat", "lon", "prev", "mode"} == set(r.asDict()) and r.prev != r["mode"] for r in changes)
    page = (tmp_path / "points_changement_map.html").read_text()
    assert f"{len(changes)} changes" in page and sum(map(int, re.findall(r"<title>[A-Z]+→[A-Z]+: ([0-9]+)</title>", page))) == len(changes)
    heat = (tmp_path / "heatmap_transitions.html").read_text()
    assert sum(map(int, re.findall(r"<title>([0-9]+)</title></rect>", heat))) == len(changes)
    for name in ("analyse_transitions.png", "analyse_demographique_transport.png"):
        assert (tmp_path / name).read_bytes().startswith(b"\x89PNG")
    users = {k: {r.user_id for r in readers.user_list(spark, f"{out}/{k}_users.json").collect()} for k in ("train", "test")}
    assert not users["train"] & users["test"] and users["train"] | users["test"] == {r.user_id for r in gps.select("user_id").distinct().collect()}
    tidy = clean.clean(gps)
    writers.cleaned(tidy, f"{out}/fichiers_nettoyes")
    again = readers.gps(spark, f"{out}/fichiers_nettoyes")
    assert again.exceptAll(tidy).count() == 0 == tidy.exceptAll(again).count()


@pytest.mark.parametrize("form", ["csv", "parquet", "json"])
def test_readers(spark, tmp_path, form):
    from modetrace.sources import readers

    trips_of = [(1, 0, 5, 9, "BUS"), (2, 1, 0, 4, None)]
    people = [(1, "F", 30, "BAC"), (2, None, None, None)]
    for name, rows, schema, read in (("d", trips_of, readers.DISPLACEMENTS, readers.displacements), ("i", people, readers.INDIVIDUALS, readers.individuals)):
        spark.createDataFrame(rows, schema).write.format(form).option("header", True).save(str(tmp_path / name))
        df = read(spark, str(tmp_path / name), form)
        assert sorted(map(tuple, df.collect())) == rows and df.schema == spark.createDataFrame([], schema).schema


def test_maps_count_every_change(spark, tmp_path, monkeypatch):
    from modetrace.sources import render

    rng = random.Random(5)
    rows = [(1, "E-1-0", i, i, 48.5 + rng.random(), 2.0 + rng.random(), *rng.sample(CANONICAL, 2)) for i in range(500)]
    changes = spark.createDataFrame(rows, CHANGE)
    for limit in (5000, 60):
        monkeypatch.setattr(render, "LIMIT", limit)
        render.transition_map(changes, str(tmp_path / "m.html"))
        render.density_map(analyse.change_density(changes), str(tmp_path / "d.html"))
        page, heat = (tmp_path / "m.html").read_text(), (tmp_path / "d.html").read_text()
        assert sum(map(int, re.findall(r"→[A-Z]+: ([0-9]+)</title>", page))) == 500 == sum(map(int, re.findall(r"<title>([0-9]+)</title>", heat)))
        assert heat.count("<rect") <= limit
    assert len(set(render.TYPES.values())) == len(render.TYPES) == 42


def test_stream_gives_the_batch_trips(spark, tmp_path):
    from modetrace.sources import fixture
    from modetrace.streaming.sessions import live_trips

    gps = fixture.gps_points(spark, "/root/testdata/sf0.001")
    gps.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live_trips(spark.readStream.schema(gps.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("live").outputMode("complete").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    batch = trips.gap_trips(clean.in_region(clean.in_range(clean.drop_missing(gps)))).groupBy("user_id", "n").count().count()
    assert spark.table("live").count() == batch


def test_one_file_a_user(spark, tmp_path):
    (tmp_path / "7.csv").write_text("event_id,t,lat,lon\n1,10,48.8,2.3\n")
    from modetrace.sources import readers

    assert readers.gps_by_file(spark, str(tmp_path)).first().user_id == 7
