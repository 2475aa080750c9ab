"""Sinks: cleaned traces, user lists, training tables, trips, change points, models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 64


def cleaned(points: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Parquet, partitioned by a bucket of users rather than by user."""
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")
    points.withColumn("user_bucket", bucket).repartition("user_bucket").sortWithinPartitions("user_bucket", "user_id", "t").write.mode("overwrite").partitionBy("user_bucket").parquet(path)


def user_lists(split: DataFrame, path: str) -> None:
    """train_users.json and test_users.json, a row a user."""
    for name in ("train", "test"):
        split.where(F.col("split") == name).select("user_id").write.mode("overwrite").json(f"{path}/{name}_users.json")


def _csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def training(rows: DataFrame, path: str, method: str) -> None:
    """One folder a method, so that the two can't be mixed up."""
    _csv(rows.withColumn("method", F.lit(method)), f"{path}/{method}")


def trips(rows: DataFrame, path: str) -> None:
    _csv(rows, f"{path}/trajets_par_utilisateur.csv")


def change_points(rows: DataFrame, path: str) -> None:
    _csv(rows, f"{path}/points_changement.csv")


def model(fitted: PipelineModel, path: str) -> None:
    fitted.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
