"""Gap-cut trips of a stream of points.

The batch operators order whole traces; on a stream a session window with a
watermark gives the same trips once their gap has passed. A gap of exactly
``gap_s`` stays within a trip, as in the batch operator: the window is a
microsecond longer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modetrace.config import DEFAULTS, Settings
from modetrace.operators.clean import drop_missing, in_range, in_region


def live_trips(points: DataFrame, s: Settings = DEFAULTS, late: str = "30 minutes") -> DataFrame:
    """(user_id, t_start, t_end, n_points) of each trip of valid points, when
    the watermark has passed its end. Points later than ``late`` are dropped."""
    valid = in_region(in_range(drop_missing(points)), s).withColumn("at", F.timestamp_micros("t")).withWatermark("at", late)
    gap = f"{s.gap_s} seconds 1 microsecond"
    return valid.groupBy("user_id", F.session_window("at", gap)).agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.count("*").alias("n_points")).drop("session_window")
