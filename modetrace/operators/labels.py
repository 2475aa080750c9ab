"""Users' split, canonical modes and the training table."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modetrace.config import ALIASES, DEFAULTS, MODE_MAP, Settings
from modetrace.operators.features import feature_names


def canonical(mode: Column) -> Column:
    """Canonical name of a declared or predicted mode, null if it has none."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in {**MODE_MAP, **ALIASES}.items()))
    return F.element_at(table, F.upper(mode))


def split_users(users: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(user_id, split): the first tenths of the users in the order of the
    MD5 of their ids train. Counts of 4096 hash ranges give each range its
    first rank, so no global sort runs in one task."""
    hashed = users.select("user_id").distinct().withColumn("h", F.md5(F.col("user_id").cast("string").cast("binary"))).withColumn("range", F.substring("h", 1, 3))
    sizes = hashed.groupBy("range").agg(F.count("*").alias("k"))
    w = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = sizes.select("range", (F.sum("k").over(w) - F.col("k")).alias("before"), F.sum("k").over(everything).alias("total"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy("h", "user_id")) + F.col("before")
    train = rank <= F.floor(F.col("total") * s.train_tenths / 10)
    return hashed.join(F.broadcast(starts), "range").select("user_id", F.when(train, "train").otherwise("test").alias("split"))  # at most 4096 rows


def of_split(df: DataFrame, split: DataFrame, name: str) -> DataFrame:
    return df.join(split.where(F.col("split") == name).select("user_id"), "user_id", "left_semi")


def declared_modes(displacements: DataFrame) -> DataFrame:
    """(user_id, trip_id, mode_1) of the declared trips."""
    return displacements.select("user_id", F.concat_ws("-", F.lit("D"), F.col("user_id").cast("string"), F.col("blk").cast("string")).alias("trip_id"), "mode_1")


def with_declared(features: DataFrame, displacements: DataFrame) -> DataFrame:
    return features.join(declared_modes(displacements), ["user_id", "trip_id"])


def build_training(features: DataFrame, displacements: DataFrame, split: DataFrame | None, method: str = "v1") -> DataFrame:
    """Features of training users' declared trips with the canonical mode;
    modes without one, OTHER among them, are left out. Without a ``split`` the
    features are those of training users already."""
    joined = with_declared(features if split is None else of_split(features, split, "train"), displacements).withColumn("mode", canonical(F.col("mode_1")))
    return joined.where(F.col("mode").isNotNull()).select("user_id", "trip_id", "seg_id", *feature_names(method), "mode")
