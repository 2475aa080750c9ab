"""Features of segments, in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modetrace.config import DEFAULTS, Settings

KEY = ("user_id", "trip_id", "seg_id")
V2 = ("hcr", "sr", "vcr", "v_max", "a_max")
V1 = (*V2, "v_median", "v_p99", "share_fast", "share_very_fast", "duration_us", "length_m")


def feature_names(method: str) -> tuple[str, ...]:
    return {"v1": V1, "v2": V2}[method]


def features(segmented: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """All features of each segment, with kind, start, end and first position.
    Rates are per metre, null for a segment without length; shares are of time."""

    def times(condition):
        return F.sum(F.when(condition, 1).otherwise(0))

    length = F.sum(F.round(F.col("dist_m") * 1000).cast("long")) / 1000.0
    kmh, timed = F.col("v") * 3.6, F.when(F.col("v").isNotNull(), F.col("dt_us"))
    total = F.sum(timed)
    first = F.min(F.struct("t", "event_id", "lat", "lon"))
    out = segmented.groupBy(*KEY, "kind").agg(
        F.coalesce(length, F.lit(0.0)).alias("length_m"),
        times(F.col("dh") > s.heading_deg).alias("turns"),
        times(F.col("v") < s.stop_mps).alias("stops"),
        times(F.col("vrate") > s.change_rate).alias("changes"),
        F.max("v").alias("v_max"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)").alias("v_median"),
        F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY v)").alias("v_p99"),
        F.max("a").alias("a_max"),
        (F.sum(F.when(kmh > s.fast_kmh, timed).otherwise(0)) / total).alias("share_fast"),
        (F.sum(F.when(kmh > s.very_fast_kmh, timed).otherwise(0)) / total).alias("share_very_fast"),
        (F.max("t") - F.min("t")).alias("duration_us"),
        F.min("t").alias("t_start"),
        F.max("t").alias("t_end"),
        first.alias("first"),
        F.count("*").alias("n_points"),
    )
    rate = {"hcr": "turns", "sr": "stops", "vcr": "changes"}
    return out.withColumns({k: F.when(F.col("length_m") > 0, F.col(c) / F.col("length_m")) for k, c in rate.items()} | {"lat": F.col("first.lat"), "lon": F.col("first.lon")}).drop("first", *rate.values())
