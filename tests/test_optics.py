"""Clusters of every radius against a plain OPTICS, and neighbours against brute force."""

import dataclasses
import math
import random

import pytest

from modetrace.config import DEFAULTS, EARTH_M
from modetrace.operators import optics, spatial
from modetrace.sources.scratch import materialise

CHANGE = "user_id long, trip_id string, seg_id long, t long, lat double, lon double, prev string, mode string"
S = dataclasses.replace(DEFAULTS, reach_m=400.0)


def metres(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return round(2 * EARTH_M * math.asin(math.sqrt(min(1.0, h))), 3)


def scattered(seed, n=110):
    """Dense stations, a chain between two of them, and lonely points."""
    rng, out = random.Random(seed), []
    for i in range(n):
        kind = rng.random()
        if kind < 0.5:
            y, x, wide = rng.choice([(48.85, 2.35, 0.0006), (48.853, 2.35, 0.0012), (48.9, 2.4, 0.002)])
            out.append((rng.gauss(y, wide), rng.gauss(x, wide)))
        elif kind < 0.75:
            out.append((48.85 + 0.0009 * rng.random() * 60, 2.36 + rng.gauss(0, 0.0004)))
        else:
            out.append((rng.uniform(48.2, 49.2), rng.uniform(1.5, 3.5)))
    return out


def frame(spark, places):
    return spark.createDataFrame([(i, f"E-{i}-0", 0, i, y, x, "BUS", "WALK") for i, (y, x) in enumerate(places)], CHANGE).repartition(4)


def plain_optics(places, weights, eps, least):
    """(order, reachability, core distance) with weighted places, by the book."""
    d = [[metres(a, b) for b in places] for a in places]
    n = len(places)

    def core(i):
        held = 0
        for m, j in sorted((d[i][j], j) for j in range(n) if d[i][j] <= eps):
            held += weights[j]
            if held >= least:
                return m
        return None

    cores = [core(i) for i in range(n)]
    reach, order, seen = [math.inf] * n, [], [False] * n
    for start in range(n):
        if seen[start]:
            continue
        queue = {start}
        while queue:
            p = min(queue, key=lambda q: (reach[q], q))
            queue.discard(p)
            seen[p] = True
            order.append(p)
            if cores[p] is None:
                continue
            for o in range(n):
                if not seen[o] and d[p][o] <= eps:
                    reach[o] = min(reach[o], max(cores[p], d[p][o]))
                    queue.add(o)
    return order, reach, cores


@pytest.fixture(scope="module")
def found(spark):
    changes = frame(spark, scattered(1))
    pairs, cores = optics.neighbourhood(changes, S)
    return changes, pairs, cores, materialise(optics.spanning_forest(pairs, cores), "forest")


def _places(changes):
    cells = {}
    for r in changes.collect():
        cell = (math.floor(r.lat * S.cluster_cells), math.floor(r.lon * S.cluster_cells))
        cells[cell] = cells.get(cell, 0) + 1
    keys = sorted(cells)
    return keys, [((y + 0.5) / S.cluster_cells, (x + 0.5) / S.cluster_cells) for y, x in keys], [cells[k] for k in keys]


def test_against_plain_optics(found):
    changes, pairs, cores, forest = found
    keys, centres, weights = _places(changes)
    order, reach, core = plain_optics(centres, weights, S.reach_m, S.dense)
    got = {(r.node >> 32, r.node & 0xFFFFFFFF): r.core for r in cores.collect()}
    assert got == {k: c for k, c in zip(keys, core, strict=True)}
    for radius in (60.0, 130.0, 280.0):
        # what the reachability order gives, cut at a radius: a new cluster where it can't be reached
        label, now = {}, None
        for p in order:
            if reach[p] > radius:
                now = p if core[p] is not None and core[p] <= radius else None
            if now is not None and core[p] is not None and core[p] <= radius:
                label[p] = now
        want = {}
        for p, c in label.items():
            want.setdefault(c, set()).add(keys[p])
        rows = {(r.lat_cell, r.lon_cell): r.cluster for r in optics.cut(pairs, cores, forest, radius).collect()}
        assert set(rows) == set(keys)
        mine = {}
        for p in label:
            mine.setdefault(rows[keys[p]], set()).add(keys[p])
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values())) != []
        near = {k for k, c in rows.items() if c >= 0}
        assert all(any(metres(centres[keys.index(k)], centres[p]) <= radius for p in label) for k in near)


def test_forest_is_least(found):
    """Its edges weigh what Kruskal's do, one by one."""
    changes, _, _, forest = found
    keys, centres, weights = _places(changes)
    _, _, core = plain_optics(centres, weights, S.reach_m, S.dense)
    n, edges = len(keys), []
    for i in range(n):
        for j in range(i + 1, n):
            m = metres(centres[i], centres[j])
            if m <= S.reach_m and core[i] is not None and core[j] is not None:
                edges.append((max(m, core[i], core[j]), i, j))
    top, kept = list(range(n)), []

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for w, i, j in sorted(edges):
        if find(i) != find(j):
            top[find(i)] = find(j)
            kept.append(w)
    assert sorted(r.reach for r in forest.collect()) == kept


def test_one_radius_is_as_before(spark, found):
    changes = found[0]
    one = optics.clusters_at(changes, (200.0,), S)
    assert sorted(map(tuple, one.select("lat_cell", "lon_cell", "cluster").collect())) == sorted(map(tuple, spatial.clusters(changes, S).collect()))
    with pytest.raises(ValueError, match="reach_m"):
        optics.clusters_at(changes, (S.reach_m + 1,), S)
    assert optics.clusters_at(changes.where("false"), (100.0,), S).count() == 0


@pytest.mark.parametrize(("seed", "k"), [(2, 4)])
def test_nearest(spark, seed, k):
    places = scattered(seed, 90)
    places += [places[0]] * 12 + [(48.21, 1.51), (49.2, 3.5)]
    df = frame(spark, places)
    got = {}
    for r in optics.nearest(df, df, ("user_id", "trip_id"), k).collect():
        got.setdefault(r.user_id, {})[r["rank"]] = (r.metres, r.near_user_id)
    want = {i: dict(enumerate(sorted((metres(a, b), j) for j, b in enumerate(places) if j != i)[:k], 1)) for i, a in enumerate(places)}
    assert got == want


def test_fewer_than_k_and_none(spark):
    df = frame(spark, [(48.5, 2.0), (48.6, 2.0)])
    assert sorted((r.user_id, r["rank"], r.near_user_id) for r in optics.nearest(df, df, ("user_id",)).collect()) == [(0, 1, 1), (1, 1, 0)]
    assert optics.nearest(df.where("false"), df, ("user_id",)).count() == 0 == optics.nearest(df, df.where("false"), ("user_id",)).count()
