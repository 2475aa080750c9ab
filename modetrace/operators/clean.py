"""Cleaning of raw points: validity, spikes, near repeats, in this order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modetrace.config import DEFAULTS, Settings
from modetrace.functions.motion import by_time, distance_m, with_steps


def drop_missing(points: DataFrame) -> DataFrame:
    """Points without both coordinates go; NaN is not null in Spark."""
    ok = [F.col(c).isNotNull() & ~F.isnan(c) for c in ("lat", "lon")]
    return points.where(ok[0] & ok[1])


def in_range(points: DataFrame) -> DataFrame:
    return points.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))


def in_region(points: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    return points.where(F.col("lat").between(*s.lat) & F.col("lon").between(*s.lon))


def drop_spikes(points: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """A point that is both reached and left faster than any vehicle goes."""
    out = F.lead("v").over(by_time("user_id"))
    spike = F.coalesce((F.col("v") > s.spike_mps) & (out > s.spike_mps), F.lit(False))
    return with_steps(points, "user_id").withColumn("spike", spike).where("NOT spike").select(*points.columns)


def merge_close(points: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Of two neighbours nearer than merge_m and merge_s the earlier stays."""
    near = F.coalesce((F.col("dist_m") < s.merge_m) & (F.col("dt_us") < s.merge_s * 1_000_000), F.lit(False))
    return with_steps(points, "user_id").where(~near).select(*points.columns)


def merge_from_kept(points: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """A point goes if it is nearer than merge_m and merge_s to the last point that
    stays, so that slow drift is not merged away step by step.

    A point merge_s or more after the one before it stays whatever went before: the
    runs between such points are independent, and each is walked by a fold that jumps
    from one point that stays to the next."""
    w, row = by_time("user_id"), F.struct("t", "event_id", *(c for c in points.columns if c not in ("t", "event_id")))
    apart = F.col("t") - F.lag("t").over(w) >= s.merge_s * 1_000_000
    runs = points.withColumn("__run", F.when(apart, 1).otherwise(0)).withColumn("__run", F.sum("__run").over(w))
    rows = runs.groupBy("user_id", "__run").agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def walk(kept: Column, now: Column) -> Column:
        last = F.element_at(kept, -1)
        near = (distance_m(last["lat"], last["lon"], now["lat"], now["lon"]) < s.merge_m) & (now["t"] - last["t"] < s.merge_s * 1_000_000)
        return F.when(F.coalesce(near, F.lit(False)), kept).otherwise(F.concat(kept, F.array(now)))

    kept = F.aggregate(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))), F.slice("rows", 1, 1), walk)
    return rows.select(F.explode(kept).alias("row")).select("row.*").select(*points.columns)


def clean(points: DataFrame, s: Settings = DEFAULTS, from_kept: bool = False) -> DataFrame:
    """Valid points of the region without spikes and near repeats; with
    ``from_kept`` the distance of a repeat is from the last point that stays."""
    calm = drop_spikes(in_region(in_range(drop_missing(points)), s), s)
    return merge_from_kept(calm, s) if from_kept else merge_close(calm, s)
