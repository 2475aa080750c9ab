"""Segments within trips: walk/other runs (method 1) or speed breaks (method 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modetrace.config import DEFAULTS, Settings
from modetrace.functions.motion import by_time, with_motion
from modetrace.operators.breaks import optimal_breaks

TRIP = ("user_id", "trip_id")


def _numbered(df: DataFrame, starts, name: str) -> DataFrame:
    """Running count of the rows of a trip that start something."""
    w = by_time(*TRIP)
    return df.withColumn("__start", F.when(starts(w), 1).otherwise(0)).withColumn(name, F.sum("__start").over(w)).drop("__start")


def label_points(trips: DataFrame, s: Settings = DEFAULTS, lane: tuple[str, ...] = TRIP) -> DataFrame:
    """Walk or other by speed and acceleration. A trip's first point, which
    has no speed, takes the label of the next; alone it is a walk."""
    moved = with_motion(trips, *lane)
    calm = F.coalesce(F.abs("a") <= s.walk_mps2, F.lit(True))
    known = F.when(F.col("v").isNotNull(), F.when((F.col("v") <= s.walk_mps) & calm, "walk").otherwise("other"))
    moved = moved.withColumn("known", known)
    return moved.withColumn("label", F.coalesce("known", F.lead("known").over(by_time(*lane)), F.lit("walk"))).drop("known")


def runs(labelled: DataFrame) -> DataFrame:
    """Number the runs of equal labels of a trip."""
    return _numbered(labelled, lambda w: F.col("label") != F.lag("label").over(w), "run")


def sub_segments(run: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Cut runs longer than max_segment_s, and number what results."""
    start = F.min("t").over(by_time(*TRIP, "run"))
    cut = run.withColumn("sub", F.floor((F.col("t") - start) / (s.max_segment_s * 1_000_000)))
    return _numbered(cut, lambda w: (F.col("run") != F.lag("run").over(w)) | (F.col("sub") != F.lag("sub").over(w)), "seg_id")


def merge_short(run: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Runs of fewer than short_points points take the label of the run
    before, and runs are numbered anew. Off by default."""
    w = by_time(*TRIP)
    sized = run.withColumn("size", F.count("*").over(Window.partitionBy(*TRIP, "run")))
    long = F.when((F.col("size") >= s.short_points) | (F.col("run") == 0), F.col("label"))
    kept = sized.withColumn("long", long).withColumn("label", F.coalesce(F.last("long", ignorenulls=True).over(w), "label"))
    return runs(kept.drop("size", "long", "run"))


def smoothed(trips: DataFrame, s: Settings = DEFAULTS, lane: tuple[str, ...] = TRIP) -> DataFrame:
    """Points with motion columns, mmps (whole mm/s) and smooth, its mean over three."""
    moved = with_motion(trips, *lane).withColumn("mmps", F.round(F.col("v") * 1000).cast("long"))
    three = by_time(*lane).rowsBetween(-1, 1)
    return moved.withColumn("smooth", F.sum("mmps").over(three) / F.count("mmps").over(three))


def speed_break(w, s: Settings = DEFAULTS):
    before = F.lag("smooth").over(w)
    return (before > 0) & (F.abs(F.col("smooth") - before) / before >= s.break_rate)


def speed_breaks(trips: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Method 2: a new segment where the speed, a mean over three points in
    whole mm/s, changes by break_rate or more."""
    return _numbered(smoothed(trips, s), lambda w: speed_break(w, s), "seg_id").drop("mmps", "smooth")


def segments(trips: DataFrame, method: str = "v1", s: Settings = DEFAULTS, merge: bool = False, optimal: bool = False) -> DataFrame:
    """Points with motion columns and seg_id, by method 'v1' or 'v2'; the breaks of
    v2 are steps of the speed or, with ``optimal``, the best change points."""
    if method == "v1":
        run = runs(label_points(trips, s))
        return sub_segments(merge_short(run, s) if merge else run, s)
    if method == "v2":
        return optimal_breaks(trips, s) if optimal else speed_breaks(trips, s)
    raise ValueError(f"method is 'v1' or 'v2', not {method!r}")
