"""Levels of the maps: each sums to all changes, and a page draws no more than its limit."""

import json
import random
import re

from modetrace.config import DEFAULTS
from modetrace.operators import analyse
from modetrace.sources import render

CHANGE = "user_id long, trip_id string, seg_id long, t long, lat double, lon double, prev string, mode string"


def frame(spark, n=400, seed=4):
    rng = random.Random(seed)
    rows = [(i, "E-0-0", i, i, min(max(rng.gauss(48.85, 0.1), 47.9), 49.4), rng.uniform(1.3, 3.7), *rng.choice([("BUS", "WALK"), ("WALK", "BUS"), ("CAR", "TRAIN")])) for i in range(n)]
    return spark.createDataFrame(rows, CHANGE).repartition(3)


def test_levels(spark):
    changes = frame(spark)
    rows = analyse.tile_pyramid(analyse.transition_labels(changes), "kind").collect()
    levels = {}
    for r in rows:
        levels.setdefault(r.level, []).append(r)
    assert sorted(levels) == list(range(DEFAULTS.tile_bits + 1))
    assert all(sum(r.n for r in v) == 400 for v in levels.values()) and {r.code for r in levels[0]} == {0}
    for level in range(DEFAULTS.tile_bits):  # a cell is the sum of its four
        finer = {}
        for r in levels[level + 1]:
            finer[(r.code >> 2, r.kind)] = finer.get((r.code >> 2, r.kind), 0) + r.n
        assert finer == {(r.code, r.kind): r.n for r in levels[level]}
    assert analyse.tile_pyramid(changes.where("false")).count() == 0


def test_cells_hold_their_points(spark):
    changes = frame(spark, 60)
    bits = DEFAULTS.tile_bits
    for r in analyse.tile_pyramid(changes).where(f"level = {bits}").collect():
        lat, lon = render.cell_centre(r.code, bits)
        half = [(b - a) / (1 << bits) / 2 + 1e-12 for a, b in (DEFAULTS.lat, DEFAULTS.lon)]
        near = changes.where(f"abs(greatest({DEFAULTS.lat[0]}, least({DEFAULTS.lat[1]}, lat)) - {lat}) <= {half[0]} AND abs(greatest({DEFAULTS.lon[0]}, least({DEFAULTS.lon[1]}, lon)) - {lon}) <= {half[1]}")
        assert near.count() >= r.n
        break


def test_page_carries_levels(spark, tmp_path, monkeypatch):
    changes = frame(spark)
    monkeypatch.setattr(render, "LIMIT", 50)
    monkeypatch.setattr(render, "EMBED", 300)
    render.transition_map(changes, str(tmp_path / "m.html"))
    page = (tmp_path / "m.html").read_text()
    levels = json.loads(re.search(r"LEVELS = (\[.*?\]);</script>", page, re.DOTALL).group(1))
    assert len(levels) > 3 and all(len(x) <= 300 and sum(m[2] for m in x) == 400 for x in levels)
    assert [len(x) for x in levels] == sorted((len(x) for x in levels), reverse=True) and "LIMIT = 50" in page
    assert sum(map(int, re.findall(r"<title>[A-Z]+→[A-Z]+: ([0-9]+)</title>", page.split("<script>")[0]))) == 400
