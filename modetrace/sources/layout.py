"""The cleaned points as a stored table that later steps start from: bucketed by
user and in order of time, so that no window by user shuffles or sorts them again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from modetrace.config import DEFAULTS, Settings
from modetrace.operators.clean import clean
from modetrace.operators.trips import with_windows
from modetrace.sources.scratch import shared_folder

BUCKETS = 64


def store(points: DataFrame, displacements: DataFrame, name: str | None = None, path: str | None = None, buckets: int = BUCKETS, s: Settings = DEFAULTS) -> str:
    """Write cleaned points with the declared window (blk) that they lie in, and
    return the table's name. One file a bucket; a table of that name is replaced."""
    spark = points.sparkSession
    name = name or f"cleaned_{uuid.uuid4().hex}"
    rows = with_windows(clean(points, s), displacements).repartition(buckets, "user_id")
    rows.write.mode("overwrite").bucketBy(buckets, "user_id").sortBy("user_id", "t", "event_id").option("path", path or shared_folder(spark, "cleaned")).saveAsTable(name)
    return name


def stored(spark: SparkSession, name: str) -> DataFrame:
    """The table's points, for ``trips.trips_of``."""
    return spark.table(name)
