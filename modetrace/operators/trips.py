"""Trips: declared time windows, and what lies outside them. Everything is in
order of time within a user, so one shuffle by user serves it all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modetrace.config import DEFAULTS, EARTH_M, Settings
from modetrace.functions.grouped import whole_groups
from modetrace.functions.motion import by_time, with_steps
from modetrace.sources.deal import dealt


POINT = ("user_id", "event_id", "t", "lat", "lon")


def disjoint_windows(displacements: DataFrame) -> DataFrame:
    """The declared windows less what an earlier one covers: disjoint, so that
    the last one to start is the only one a point can lie in."""
    before = Window.partitionBy("user_id").orderBy("t_start", "blk").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.max("t_end").over(before) + 1
    return displacements.select("user_id", "blk", F.greatest("t_start", covered).alias("t_start"), "t_end").where("t_start <= t_end")


def with_windows(points: DataFrame, displacements: DataFrame, tasks: int | None = None) -> DataFrame:
    """Points with the blk of the declared window they lie in, of several the
    earliest, or null. A merge in order of time: window starts are rows among
    the points, and each point looks back at the last one. One sort by user,
    whatever the number of windows."""
    starts = disjoint_windows(displacements).select("user_id", F.col("t_start").alias("t"), F.struct("blk", "t_end").alias("window"))
    both = points.select(*POINT, F.lit(True).alias("is_point")).unionByName(starts.withColumn("is_point", F.lit(False)), allowMissingColumns=True)
    both, w = dealt(both, tasks, "user_id"), Window.partitionBy("user_id").orderBy("t", "is_point", "event_id")
    last = F.last("window", ignorenulls=True).over(w)
    return both.withColumn("window", last).where("is_point").select(*POINT, F.when(F.col("t") <= F.col("window.t_end"), F.col("window.blk")).alias("blk"))


def trip_name(letter: str, number: str) -> Column:
    return F.concat_ws("-", F.lit(letter), F.col("user_id").cast("string"), F.col(number).cast("string"))


def declared_points(points: DataFrame, displacements: DataFrame) -> DataFrame:
    """Points inside a declared window, with its blk."""
    return with_windows(points, displacements).where("blk IS NOT NULL")


def extra_points(points: DataFrame, displacements: DataFrame) -> DataFrame:
    """Points outside all declared windows."""
    return with_windows(points, displacements).where("blk IS NULL").drop("blk")


def gap_trips(points: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Number the runs of a user's points without a gap of more than gap_s."""
    w = by_time("user_id")
    cut = F.when(F.col("t") - F.lag("t").over(w) > s.gap_s * 1_000_000, 1).otherwise(0)
    return points.withColumn("cut", cut).withColumn("n", F.sum("cut").over(w)).drop("cut")


def stay_points(points: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(user_id, event_id, stay): whether a point belongs to a stay.

    An anchor starts a stay if every following point up to stay_s or more
    later lies within stay_m of it; the scan goes on after the stay. It is
    sequential, but no stay holds two neighbours more than twice stay_m apart:
    a user's points are cut there. Pieces come to Python in order, many at a time;
    those shorter than stay_s have no stay, and of the others' points only those are
    anchors whose first point stay_s or more later lies within stay_m.
    """
    radius, least = s.stay_m, s.stay_s * 1_000_000

    def metres(lat, lon, lat_2, lon_2):
        h = np.sin((lat_2 - lat) / 2) ** 2 + np.cos(lat) * np.cos(lat_2) * np.sin((lon_2 - lon) / 2) ** 2
        return np.round(2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1, h))), 3)

    def scan(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, stay: np.ndarray) -> None:
        n = len(t)
        later = np.searchsorted(t, t + least)  # the first point that makes a stay long enough
        anchors = np.flatnonzero(later < n)
        far = later[anchors]
        anchors = anchors[metres(lat[anchors], lon[anchors], lat[far], lon[far]) <= radius]
        k = 0
        while k < len(anchors):
            i = int(anchors[k])
            j, size = i + 1, 64
            while j < n:  # look ahead in growing blocks until a point is outside
                stop = min(n, j + size)
                out = np.flatnonzero(metres(lat[i], lon[i], lat[j:stop], lon[j:stop]) > radius)
                if len(out):
                    j += int(out[0])
                    break
                j, size = stop, size * 2
            if t[j - 1] - t[i] >= least:
                stay[i:j] = True
                k = int(np.searchsorted(anchors, j))
            else:
                k += 1

    def scan_all(batches):
        for rows in whole_groups(batches, "starts"):
            t, lat, lon, starts = (rows.column(c).to_numpy() for c in ("t", "lat", "lon", "starts"))
            lat, lon, stay = np.radians(lat), np.radians(lon), np.zeros(len(t), dtype=bool)
            first = np.flatnonzero(starts)
            end = np.append(first[1:], len(t))
            for k in np.flatnonzero(t[end - 1] - t[first] >= least):
                a, b = first[k], end[k]
                scan(t[a:b], lat[a:b], lon[a:b], stay[a:b])
            yield from pa.table({"user_id": rows.column("user_id"), "event_id": rows.column("event_id"), "stay": pa.array(stay)}).to_batches()

    w = by_time("user_id")
    starts = F.lag("t").over(w).isNull() | F.coalesce(F.col("dist_m") > 2 * radius + 0.01, F.lit(False))  # distances are rounded
    pieces = with_steps(points.select(*POINT), "user_id").select(*POINT, starts.alias("starts"))
    return pieces.sortWithinPartitions("user_id", "t", "event_id").mapInArrow(scan_all, "user_id long, event_id long, stay boolean")


def trips(points: DataFrame, displacements: DataFrame, s: Settings = DEFAULTS, stays: bool = False, tasks: int | None = None) -> DataFrame:
    """All points with kind (declared or extra) and trip_id. Extra trips end at
    a gap of more than gap_s between extra points and, with ``stays``, where a
    stay ends; points of stays belong to the trip before."""
    return trips_of(with_windows(points, displacements, tasks), s, stays)


def trips_of(found: DataFrame, s: Settings = DEFAULTS, stays: bool = False) -> DataFrame:
    """``trips`` of points that have the blk of their window."""
    if stays:
        found = found.join(stay_points(found.where("blk IS NULL"), s), ["user_id", "event_id"], "left")
    extra, before = F.col("blk").isNull(), by_time("user_id").rowsBetween(Window.unboundedPreceding, -1)

    def last(column: str):
        """The value at the extra point before."""
        return F.last(F.when(extra, F.col(column)), ignorenulls=True).over(before)

    ends = F.col("t") - last("t") > s.gap_s * 1_000_000
    if stays:
        ends = ends | (last("stay") & ~F.col("stay"))
    numbered = found.withColumn("cut", F.when(extra & ends, 1).otherwise(0)).withColumn("n", F.sum("cut").over(by_time("user_id")))

    return numbered.select(*POINT, F.when(extra, "extra").otherwise("declared").alias("kind"), F.when(extra, trip_name("E", "n")).otherwise(trip_name("D", "blk")).alias("trip_id"))
