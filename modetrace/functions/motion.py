"""Distance, speed, acceleration and heading between neighbouring points.

Distances are rounded to millimetres and headings to a thousandth of a degree before
anything compares them, so that results do not hang on the last bit of a sine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modetrace.config import EARTH_M


def by_time(*partition: str):
    return Window.partitionBy(*partition).orderBy("t", "event_id")


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.round(2 * EARTH_M * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h))), 3)


def heading_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    y = F.sin(F.radians(lon2 - lon1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    return F.round(F.degrees(F.atan2(y, x)), 3) + 0.0


def with_steps(points: DataFrame, *partition: str) -> DataFrame:
    """Add dist_m, dt_us and v (m/s, null where no time passed) from the
    previous point of the partition."""
    w = by_time(*partition)
    lat, lon, t = (F.lag(c).over(w) for c in ("lat", "lon", "t"))
    stepped = points.withColumn("dist_m", distance_m(lat, lon, F.col("lat"), F.col("lon"))).withColumn("dt_us", F.col("t") - t)
    return stepped.withColumn("v", F.when(F.col("dt_us") > 0, F.col("dist_m") / (F.col("dt_us") / 1e6)))


def with_motion(points: DataFrame, *partition: str) -> DataFrame:
    """``with_steps`` and a (m/s2), heading, dh (heading change) and vrate
    (relative speed change)."""
    w = by_time(*partition)
    lat, lon = (F.lag(c).over(w) for c in ("lat", "lon"))
    moved = with_steps(points, *partition).withColumn("heading", heading_deg(lat, lon, F.col("lat"), F.col("lon")))
    v0, turn = F.lag("v").over(w), F.abs(F.col("heading") - F.lag("heading").over(w))
    return (
        moved.withColumn("a", F.when(F.col("dt_us") > 0, (F.col("v") - v0) / (F.col("dt_us") / 1e6)))
        .withColumn("dh", F.round(F.least(turn, 360 - turn), 3))
        .withColumn("vrate", F.when(v0 > 0, F.abs(F.col("v") - v0) / v0))
    )
