"""Scans with explicit schemas: GPS traces, displacements, individuals, user lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GPS = "user_id long, event_id long, t long, lat double, lon double"
DISPLACEMENTS = "user_id long, blk long, t_start long, t_end long, mode_1 string"
INDIVIDUALS = "user_id long, sex string, age int, diploma string"
SPLIT = "user_id long, split string"


def _read(spark: SparkSession, path: str, schema: str, form: str) -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if form == "csv" else reader.format(form).load(path)


def gps(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """All users' traces at once, from a folder of files of any split."""
    return _read(spark, path, GPS, form).select("user_id", "event_id", "t", "lat", "lon")


def gps_by_file(spark: SparkSession, path: str, form: str = "csv") -> DataFrame:
    """Traces of one file a user without a user column: the file's name, less
    its ending, is the user."""
    schema = "event_id long, t long, lat double, lon double"
    user = F.regexp_extract(F.col("_metadata.file_name"), r"^([0-9]+)\.", 1).cast("long")
    return _read(spark, path, schema, form).withColumn("user_id", user).select("user_id", "event_id", "t", "lat", "lon")


def displacements(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return _read(spark, path, DISPLACEMENTS, form)


def individuals(spark: SparkSession, path: str, form: str = "csv") -> DataFrame:
    return _read(spark, path, INDIVIDUALS, form)


def user_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("user_id long").json(path)


def training(spark: SparkSession, path: str, method: str) -> DataFrame:
    """A training table written by ``writers.training``; its features decide
    whether it is one of this method's."""
    from modetrace.operators.model import check_features

    found = spark.read.option("header", True).option("inferSchema", False).csv(f"{path}/{method}")
    check_features(found, method)
    text = {"user_id": "long", "seg_id": "long", "trip_id": "string", "mode": "string", "method": "string"}
    return found.withColumns({c: F.col(c).cast(text.get(c, "double")) for c in found.columns})
