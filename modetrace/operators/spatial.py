"""Spatial post-processing, off by default: radius neighbours by a grid join,
density clusters of change points, and Bayes with a cluster's modes.

Places are counted first. A place lies on a fixed grid, so a cell of the radius
holds a bounded number of them, however many changes a busy station has: joins
of neighbouring places never grow with the square of the points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modetrace.config import CANONICAL, DEFAULTS, EARTH_M, Settings
from modetrace.functions.graph import connected
from modetrace.functions.motion import distance_m
from modetrace.sources.scratch import materialise

#: Metres that the cells must span at least; a degree of latitude has 111 195.
DEGREE_M = 111_000


def place_cells(per_degree: int) -> list[Column]:
    return [F.floor(F.col(c) * per_degree).alias(f"{c}_cell") for c in ("lat", "lon")]


def neighbours(places: DataFrame, per_degree: int, s: Settings, radius_m: float | None = None) -> DataFrame:
    """Pairs of ``places`` (lat_cell, lon_cell, n) whose centres lie within
    radius_m: (lat_cell, lon_cell, n, lat_2, lon_2, n_2, metres), each place
    with itself too. A place looks in its own cell of the radius and the eight
    around, which one step covers up to the northern edge of the region."""
    radius = s.radius_m if radius_m is None else radius_m
    lat = radius / DEGREE_M
    lon = lat / math.cos(math.radians(s.lat[1]))
    y, x = ((F.col(c) + 0.5) / per_degree for c in ("lat_cell", "lon_cell"))
    at = places.withColumns({"y": y, "x": x, "ci": F.floor(y / lat), "cj": F.floor(x / lon)})
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    left = at.withColumn("o", around).withColumns({"ci": F.col("ci") + F.col("o.di"), "cj": F.col("cj") + F.col("o.dj")}).drop("o")
    right = at.select("ci", "cj", F.col("y").alias("y2"), F.col("x").alias("x2"), F.col("lat_cell").alias("lat_2"), F.col("lon_cell").alias("lon_2"), F.col("n").alias("n_2"))
    pairs = left.join(right, ["ci", "cj"]).withColumn("metres", distance_m(F.col("y"), F.col("x"), F.col("y2"), F.col("x2")))
    return pairs.where(F.col("metres") <= radius).select("lat_cell", "lon_cell", "n", "lat_2", "lon_2", "n_2", "metres")


def slack_m(per_degree: int) -> float:
    """How far the distance of two points can be from that of their places' centres."""
    return math.sqrt(2) * math.radians(1 / per_degree) * EARTH_M + 0.01


def radius_counts(changes: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(user_id, trip_id, seg_id, n): other change points within radius_m.

    Places of 1/places_per_degree settle most of it: of a pair of places that is
    wholly within the radius the count is added, one wholly beyond it is
    dropped. A pair on the rim is looked at again by the ``finer`` x ``finer``
    parts of both places, ``refined`` times, and only what is still on the rim
    point by point; points at one position are one row with a count. So a busy
    station's points are compared with those on a thin ring around them.
    Changes without a position have no row.
    """
    placed = changes.select("user_id", "trip_id", "seg_id", (F.col("lat") + 0.0).alias("lat"), (F.col("lon") + 0.0).alias("lon")).where("lat IS NOT NULL AND lon IS NOT NULL")
    finest = s.places_per_degree * s.finer**s.refined
    cells = [F.floor(F.col(c) * finest).alias(f"{c}_{s.refined}") for c in ("lat", "lon")]
    for level in range(s.refined - 1, -1, -1):  # from the level below, so that parts always lie in their place
        cells += [F.floor(F.floor(F.col(c) * finest) / s.finer ** (s.refined - level)).alias(f"{c}_{level}") for c in ("lat", "lon")]
    points = materialise(placed.groupBy("lat", "lon").agg(F.count("*").alias("n")).select("lat", "lon", "n", *cells), "positions")

    def parts(level: int) -> DataFrame:
        return points.groupBy(f"lat_{level}", f"lon_{level}", *((f"lat_{level - 1}", f"lon_{level - 1}") if level else ())).agg(F.sum("n").alias("n"))

    first = neighbours(parts(0).toDF("lat_cell", "lon_cell", "n"), s.places_per_degree, s, s.radius_m + slack_m(s.places_per_degree))
    rim, inside = first.select("lat_cell", "lon_cell", "lat_2", "lon_2", "n_2", "metres"), []
    for level in range(s.refined + 1):
        slack = slack_m(s.places_per_degree * s.finer**level)
        if level:
            rim = _parts_of(rim, parts(level), level, s)
        within = F.col("metres") <= s.radius_m - slack
        inside.append(rim.where(within).groupBy("lat_cell", "lon_cell").agg(F.sum("n_2").alias(f"within_{level}")).toDF(f"lat_{level}", f"lon_{level}", f"within_{level}"))
        rim = materialise(rim.where(~within & (F.col("metres") <= s.radius_m + slack)), "rim")
    last = [f"lat_{s.refined}", f"lon_{s.refined}"]
    one = points.select("lat", "lon", F.col(last[0]).alias("lat_cell"), F.col(last[1]).alias("lon_cell"))
    two = points.select(F.col("lat").alias("y2"), F.col("lon").alias("x2"), F.col("n").alias("n_2"), F.col(last[0]).alias("lat_2"), F.col(last[1]).alias("lon_2"))
    near = rim.drop("n_2", "metres").join(one, ["lat_cell", "lon_cell"]).join(two, ["lat_2", "lon_2"]).where(distance_m(F.col("lat"), F.col("lon"), F.col("y2"), F.col("x2")) <= s.radius_m)
    counted = points.join(near.groupBy("lat", "lon").agg(F.sum("n_2").alias("near")), ["lat", "lon"], "left")
    for level, found in enumerate(inside):
        counted = counted.join(found, [f"lat_{level}", f"lon_{level}"], "left")
    total = sum((F.coalesce(F.col(f"within_{level}"), F.lit(0)) for level in range(s.refined + 1)), F.coalesce("near", F.lit(0)))
    return placed.join(counted.select("lat", "lon", (total - 1).alias("n")), ["lat", "lon"]).select("user_id", "trip_id", "seg_id", "n")


def _parts_of(rim: DataFrame, parts: DataFrame, level: int, s: Settings) -> DataFrame:
    """Pairs of places on the rim as pairs of their parts, with the distance of the parts' centres."""
    above = parts.toDF("lat_part", "lon_part", "lat_cell", "lon_cell", "n")
    pairs = rim.select("lat_cell", "lon_cell", "lat_2", "lon_2").join(above.drop("n"), ["lat_cell", "lon_cell"])
    pairs = pairs.join(above.toDF("lat_part_2", "lon_part_2", "lat_2", "lon_2", "n_2"), ["lat_2", "lon_2"])
    y, x, y2, x2 = ((F.col(c) + 0.5) / (s.places_per_degree * s.finer**level) for c in ("lat_part", "lon_part", "lat_part_2", "lon_part_2"))
    return pairs.select(F.col("lat_part").alias("lat_cell"), F.col("lon_part").alias("lon_cell"), F.col("lat_part_2").alias("lat_2"), F.col("lon_part_2").alias("lon_2"), "n_2", distance_m(y, x, y2, x2).alias("metres"))


def clusters(changes: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(lat_cell, lon_cell, cluster) of the places with change points, of
    1/cluster_cells of a degree: the density clusters that the reachability
    order of OPTICS gives when it is cut at radius_m.

    A place with ``dense`` changes or more within the radius is a core; cores
    within the radius of each other are one cluster, named by the least of its
    places; a place near a core joins the nearest one's cluster (of equally near
    ones the least), and the rest have -1.
    """
    places = changes.groupBy(*place_cells(s.cluster_cells)).agg(F.count("*").alias("n"))
    pairs = neighbours(places, s.cluster_cells, s)
    name = [(F.col(a) * (1 << 32) + F.col(b)).alias(c) for a, b, c in (("lat_cell", "lon_cell", "u"), ("lat_2", "lon_2", "v"))]
    cores = pairs.groupBy("lat_cell", "lon_cell").agg(F.sum("n_2").alias("around")).where(F.col("around") >= s.dense).select("lat_cell", "lon_cell")
    to_core = pairs.join(cores.toDF("lat_2", "lon_2"), ["lat_2", "lon_2"])
    links = to_core.join(cores, ["lat_cell", "lon_cell"]).select(*name)
    root = connected(links)
    alone = cores.select((F.col("lat_cell") * (1 << 32) + F.col("lon_cell")).alias("node"))
    grouped = alone.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = grouped.join(grouped.groupBy("root").agg(F.min("node").alias("cluster")), "root").select("node", "cluster")
    joined = to_core.select("lat_cell", "lon_cell", "metres", name[1].alias("node")).join(named, "node")
    nearest = joined.groupBy("lat_cell", "lon_cell").agg(F.min(F.struct("metres", "cluster")).alias("best"))
    return places.join(nearest, ["lat_cell", "lon_cell"], "left").select("lat_cell", "lon_cell", F.coalesce("best.cluster", F.lit(-1)).alias("cluster"))


def spatial_post_process(predictions: DataFrame, changes: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Weak predictions in a cluster's place take the mode with the greatest
    product of its probability and its share of the changes in the cluster."""
    found = clusters(changes, s).where("cluster >= 0")
    modes = changes.select("mode", *place_cells(s.cluster_cells)).join(found, ["lat_cell", "lon_cell"]).groupBy("cluster", "mode").agg(F.count("*").alias("n"))
    share = modes.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("cluster"))).groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("mode", "share"))).alias("shares"))
    prior = found.join(share, "cluster").select("lat_cell", "lon_cell", "shares")
    joined = predictions.select("*", *place_cells(s.cluster_cells)).join(prior, ["lat_cell", "lon_cell"], "left")
    best = F.array_max(F.array(*(F.struct((F.col(f"p_{m.lower()}") * F.coalesce(F.try_element_at("shares", F.lit(m)), F.lit(0.0))).alias("score"), F.lit(m).alias("mode")) for m in CANONICAL)))
    weak = (F.col("confidence") < s.tau) & F.col("shares").isNotNull()
    return joined.withColumn("best", best).withColumn("mode", F.when(weak & (F.col("best.score") > 0), F.col("best.mode")).otherwise(F.col("mode"))).select(*predictions.columns)
