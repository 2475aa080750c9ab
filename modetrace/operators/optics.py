"""Density clusters of every radius at once, as the reachability order of OPTICS has
them, and nearest neighbours.

A place's core distance is the least radius around it that holds ``dense`` changes.
Two places reach each other at the greatest of their core distances and their own
distance. A minimum spanning forest of that graph, found over the pairs that a grid
join gives within ``reach_m``, holds the clusters of every radius up to it: those at r
are the components of the edges up to r between places whose core distance is r at most.
They are read from the forest without looking at pairs again.
"""

from __future__ import annotations

import dataclasses
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modetrace.config import DEFAULTS, Settings
from modetrace.functions.graph import components, least_forest
from modetrace.functions.motion import distance_m
from modetrace.operators.spatial import DEGREE_M, neighbours, place_cells
from modetrace.sources.deal import dealt, parts_for, tasks_for
from modetrace.sources.scratch import discard, materialise


def _node(lat: str, lon: str) -> Column:
    return F.col(lat) * (1 << 32) + F.col(lon)


def _lat_cell(node: str) -> Column:
    return F.floor(F.col(node) / (1 << 32))


def _lon_cell(node: str) -> Column:
    return F.pmod(node, F.lit(1 << 32))


def neighbourhood(changes: DataFrame, s: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(pairs, cores): pairs (node, other, metres, n_other) of places within reach_m, each
    with itself, and (node, core), null where reach_m doesn't hold ``dense`` changes.
    Both are written."""
    places = changes.groupBy(*place_cells(s.cluster_cells)).agg(F.count("*").alias("n"))
    near = neighbours(places, s.cluster_cells, dataclasses.replace(s, radius_m=s.reach_m))
    pairs = materialise(near.select(_node("lat_cell", "lon_cell").alias("node"), _node("lat_2", "lon_2").alias("other"), "metres", F.col("n_2").alias("n_other")), "place-pairs")
    # changes by distance: rings of equal distance first, so that a place has few rows
    rings = pairs.groupBy("node", "metres").agg(F.sum("n_other").alias("n"))
    held = F.sum("n").over(Window.partitionBy("node").orderBy("metres"))
    cores = rings.withColumn("held", held).groupBy("node").agg(F.min(F.when(F.col("held") >= s.dense, F.col("metres"))).alias("core"))
    return pairs, materialise(cores, "cores")


def short_edges(pairs: DataFrame, cores: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(node, other, reach) of the pairs that a minimum spanning forest may need: a few a
    place, however many places lie around it.

    Around a place there are eight sectors of 45 degrees. Of two places in one sector the
    further is nearer to the closer one than to the middle. So if the closer one's core
    distance is at most the further one's reach, both other sides of the triangle reach
    no further than its edge and are shorter: the longest side of a triangle is not needed."""
    have = cores.where("core IS NOT NULL")
    edges = dealt(pairs.where("node <> other"), tasks_for(pairs.sparkSession, pairs.count()), "node").join(have, "node").join(have.toDF("other", "core_2"), "other")
    lat, lon, lat_2, lon_2 = (f(c) for c in ("node", "other") for f in (_lat_cell, _lon_cell))
    turn = F.atan2((lat_2 - lat).cast("double"), (lon_2 - lon) * F.cos(F.radians((lat + 0.5) / s.cluster_cells)))
    sector = F.floor((turn + math.pi) / (math.pi / 4))
    closer = Window.partitionBy("node", "sector").orderBy("metres", "other").rowsBetween(Window.unboundedPreceding, -1)
    reached = edges.select("node", "other", "metres", "core_2", F.greatest("metres", "core", "core_2").alias("reach"), sector.alias("sector"))
    least = F.min("core_2").over(closer)
    return reached.withColumn("least", least).where("least IS NULL OR least > reach").select("node", "other", "reach")


def spanning_forest(pairs: DataFrame, cores: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(u, v, reach): a minimum spanning forest of the places with a core distance. Of
    equal edges the one of the lesser nodes counts as less, which makes it one forest."""
    edges = short_edges(pairs, cores, s).where("node < other").select(F.col("node").alias("u"), F.col("other").alias("v"), F.col("reach").alias("weight"))
    return least_forest(edges).withColumnRenamed("weight", "reach")


def cuts(pairs: DataFrame, cores: DataFrame, forest: DataFrame, radii: tuple[float, ...]) -> DataFrame:
    """(radius, lat_cell, lon_cell, cluster) of every place at radii up to reach_m, as
    ``spatial.clusters`` names them. All radii are one job: a place has a copy for each."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(r)).alias("radius")) for i, r in enumerate(radii))))

    def copies(df: DataFrame) -> DataFrame:
        return df.withColumn("at", each).select(*df.columns, "at.*")

    def copy(node: str) -> Column:
        return (F.col(node) * len(radii) + F.col("i")).alias(node)

    inside = copies(cores).where("core <= radius").select("i", "node", copy("node").alias("copy"))
    root = components(copies(forest).where("reach <= radius").select(copy("u"), copy("v"), F.col("reach").alias("weight")))
    grouped = inside.join(root.withColumnRenamed("node", "copy"), "copy", "left").withColumn("root", F.coalesce("root", "copy"))
    named = materialise(grouped.join(grouped.groupBy("root").agg(F.min("node").alias("cluster")), "root").select("i", "node", "cluster"), "named")
    to_core = copies(pairs).where("metres <= radius").join(named.withColumnRenamed("node", "other"), ["i", "other"])
    nearest = to_core.groupBy("node", "i").agg(F.min(F.struct("metres", "cluster")).alias("best"))
    cells = [_lat_cell("node").alias("lat_cell"), _lon_cell("node").alias("lon_cell")]
    return copies(cores).join(nearest, ["node", "i"], "left").select("radius", *cells, F.coalesce("best.cluster", F.lit(-1)).alias("cluster"))


def cut(pairs: DataFrame, cores: DataFrame, forest: DataFrame, radius_m: float) -> DataFrame:
    """(lat_cell, lon_cell, cluster) of every place at one radius."""
    return cuts(pairs, cores, forest, (radius_m,)).drop("radius")


def clusters_at(changes: DataFrame, radii: tuple[float, ...], s: Settings = DEFAULTS) -> DataFrame:
    """(radius, lat_cell, lon_cell, cluster) at each of the radii, from one forest."""
    if max(radii) > s.reach_m:
        raise ValueError(f"radii go up to reach_m, {s.reach_m}")
    pairs, cores = neighbourhood(changes, s)
    forest = materialise(spanning_forest(pairs, cores, s), "forest")
    return cuts(pairs, cores, forest, radii)


def nearest(queries: DataFrame, points: DataFrame, key: tuple[str, ...], k: int | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """(query columns, rank, near_<key>, metres): for each row of ``queries`` its ``k``
    nearest rows of ``points`` with another key, ties to the lesser key; fewer if there
    are fewer. Both have ``key``, lat and lon.

    Points fall into cells of a few metres. A query looks at its own cell and those
    around; all other points are further than a cell's side, so that it is done when
    its k-th is no further. Those that aren't look again with cells four times as wide,
    where only their neighbourhoods are joined. Rows at one position are cut to the k + 1
    least keys first, so that a busy spot is a few rows. Dense areas are done in small
    cells, from the size that ``first_side`` finds; wide ones are for empty areas.
    """
    k = k or s.nearest
    here = Window.partitionBy("lat", "lon").orderBy(*key)
    distinct = points.select(*key, "lat", "lon").withColumn("__place", F.row_number().over(here)).where(F.col("__place") <= k + 1).drop("__place")
    sites = materialise(distinct.select(F.struct(*key).alias("near"), F.col("lat").alias("lat_2"), F.col("lon").alias("lon_2")), "sites")
    waiting = materialise(queries.select(*key, "lat", "lon"), "waiting")
    done, side = [], first_side(waiting, sites, s)
    while True:
        last = side > s.lat_span_m()
        found = _look(waiting, sites, key, k, side, last, s)
        done.append(found.where("sure"))
        if last:
            break
        left = materialise(waiting.join(found.where("sure").select(*key).distinct(), list(key), "left_anti"), "waiting")
        discard(waiting)
        waiting, side = left, side * 4
        if waiting.isEmpty():
            break
    every = reduce(DataFrame.unionByName, done)
    return every.select(*key, "rank", *(F.col(f"near.{c}").alias(f"near_{c}") for c in key), "metres")


def _grid(side: float, s: Settings) -> tuple[float, float]:
    """Degrees of latitude and longitude that span ``side`` metres at least, up to the northern edge."""
    lat = side / DEGREE_M
    return lat, lat / math.cos(math.radians(s.lat[1]))


def first_side(queries: DataFrame, sites: DataFrame, s: Settings = DEFAULTS) -> float:
    """The widest cells, of nearest_cell_m or a quarter as often as it takes, in which a query
    meets nearest_crowd sites of its own cell at most, on average: where the same area
    gets more points, a query still looks at as many."""
    sides = [s.nearest_cell_m / 4**i for i in range(s.nearest_finer + 1)]

    def held(df: DataFrame, lat: str, lon: str, name: str) -> DataFrame:
        cells = (F.struct(F.lit(i).alias("i"), F.floor(F.col(lat) / y).alias("ci"), F.floor(F.col(lon) / x).alias("cj")) for i, (y, x) in enumerate(_grid(side, s) for side in sides))
        return df.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.i", "c.ci", "c.cj").agg(F.count("*").alias(name))

    both = held(queries, "lat", "lon", "n").join(held(sites, "lat_2", "lon_2", "n_2"), ["i", "ci", "cj"])
    met = {r.i: r.pairs for r in both.groupBy("i").agg(F.sum(F.col("n") * F.col("n_2")).alias("pairs")).collect()}
    most = s.nearest_crowd * queries.count()
    return next((side for i, side in enumerate(sides) if met.get(i, 0) <= most), sides[-1])


def _look(waiting: DataFrame, sites: DataFrame, key: tuple[str, ...], k: int, side: float, last: bool, s: Settings) -> DataFrame:
    """The best k of each query among its cells, and whether they are sure; written.

    Pairs of a query and a site are counted by cell first and dealt out by their number, a busy
    cell's queries to several tasks."""
    lat, lon = _grid(side, s)
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    left = waiting.withColumn("o", around).withColumns({"ci": F.floor(F.col("lat") / lat) + F.col("o.i"), "cj": F.floor(F.col("lon") / lon) + F.col("o.j")}).drop("o")
    if last:  # what is left looks at everything, in as many parts as there are tasks
        parts = int(waiting.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        left = waiting.withColumns({"ci": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "cj": F.lit(0)})
        right = sites.withColumns({"ci": F.pmod(F.xxhash64("near"), F.lit(parts)).cast("int"), "cj": F.lit(0)})
    else:
        right = sites.withColumns({"ci": F.floor(F.col("lat_2") / lat), "cj": F.floor(F.col("lon_2") / lon)})
    n, n_2 = (df.groupBy("ci", "cj").agg(F.count("*").alias(c)) for df, c in ((left, "n"), (right, "n_2")))
    met = materialise(n.join(n_2, ["ci", "cj"]).select("ci", "cj", (F.col("n") * F.col("n_2")).alias("pairs")), "met")
    tasks = tasks_for(met.sparkSession, met.agg(F.sum("pairs")).first()[0] or 0)
    busy = F.broadcast(met.select("ci", "cj", parts_for(F.col("pairs")).alias("parts")).where("parts > 1"))  # a row a task, at most
    left, right = (df.join(busy, ["ci", "cj"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))) for df in (left, right))
    left = dealt(left.withColumn("part", F.pmod(F.xxhash64(*key), F.col("parts"))).drop("parts"), tasks, "ci", "cj", "part")
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    both = left.join(right, ["ci", "cj", "part"]).where(F.struct(*key) != F.col("near"))
    both = both.withColumn("metres", distance_m(F.col("lat"), F.col("lon"), F.col("lat_2"), F.col("lon_2")))
    own = Window.partitionBy(*key)
    ranked = both.withColumn("rank", F.row_number().over(own.orderBy("metres", "near"))).where(F.col("rank") <= k)
    # distances are rounded, so a millimetre less than the side
    sure = F.lit(True) if last else (F.count("*").over(own) == k) & (F.max("metres").over(own) < side - 0.001)
    found = materialise(ranked.select(*key, "rank", "near", "metres", sure.alias("sure")), "nearest")
    discard(met)
    return found
