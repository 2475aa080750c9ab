"""Smoothing of predictions, and what is measured on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modetrace.config import CANONICAL, DEFAULTS, Settings
from modetrace.operators.labels import canonical, declared_modes
from modetrace.operators.trips import disjoint_windows, trip_name
from modetrace.sources.deal import dealt

TRIP = ("user_id", "trip_id")


def by_segment(lane: tuple[str, ...] = TRIP):
    """Segments of a trip in order of time."""
    return Window.partitionBy(*lane).orderBy("t_start", "seg_id")


def transition_matrix(predictions: DataFrame) -> DataFrame:
    """(prev, next, n, p): at most 49 rows; p sums to 1 over next."""
    return matrix_of(predictions.select(F.lag("mode").over(by_segment()).alias("prev"), F.col("mode").alias("next")))


def matrix_of(pairs: DataFrame) -> DataFrame:
    """The matrix of (prev, next), a row a segment; its first has no prev."""
    pairs = pairs.where("prev IS NOT NULL")
    n = pairs.groupBy("prev", "next").agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("prev")))


def correct_by_transitions(predictions: DataFrame, matrix: DataFrame, s: Settings = DEFAULTS, lane: tuple[str, ...] = TRIP) -> DataFrame:
    """Predictions below tau take the mode with the greatest product of its
    probability and of the transition from the mode before; ties go to the
    later name. Without a mode before, or a transition from it, they stay."""
    before = predictions.withColumn("prev", F.lag("mode").over(by_segment(lane)))
    rows = matrix.groupBy("prev").agg(F.map_from_entries(F.collect_list(F.struct("next", "p"))).alias("to"))
    joined = before.join(F.broadcast(rows), "prev", "left")  # at most one row a mode
    options = F.array(*(F.struct((F.col(f"p_{m.lower()}") * F.coalesce(F.try_element_at("to", F.lit(m)), F.lit(0.0))).alias("score"), F.lit(m).alias("mode")) for m in CANONICAL))
    best = F.array_max(options)
    weak = (F.col("confidence") < s.tau) & F.col("to").isNotNull()
    return joined.withColumn("best", best).withColumn("mode", F.when(weak & (F.col("best.score") > 0), F.col("best.mode")).otherwise(F.col("mode"))).select(*predictions.columns)


def sliding_majority_vote(predictions: DataFrame, k: int | None = None, s: Settings = DEFAULTS, lane: tuple[str, ...] = TRIP) -> DataFrame:
    """The commonest mode of the k segments around, within the trip; edges are
    cut short and ties go to the first name."""
    half = (k or s.vote) // 2
    around = F.collect_list("mode").over(by_segment(lane).rowsBetween(-half, half))
    counted = F.transform(F.array_distinct("around"), lambda m: F.struct((-F.size(F.filter("around", lambda x: x == m))).alias("n"), m.alias("mode")))
    return predictions.withColumn("around", around).withColumn("mode", F.array_min(counted)["mode"]).select(*predictions.columns)


def fusion_segments(predictions: DataFrame, lane: tuple[str, ...] = TRIP) -> DataFrame:
    """A, B, A becomes A, A, A; all at once, from the modes as they were."""
    a, b = F.lag("mode").over(by_segment(lane)), F.lead("mode").over(by_segment(lane))
    return predictions.withColumn("mode", F.when((a == b) & (a != F.col("mode")), a).otherwise(F.col("mode")))


def normalise_names(predictions: DataFrame) -> DataFrame:
    """Canonical names; a mode without one stays, in upper case."""
    return predictions.withColumn("mode", F.coalesce(canonical(F.col("mode")), F.upper("mode")))


def post_process(predictions: DataFrame, matrix: DataFrame, s: Settings = DEFAULTS, lane: tuple[str, ...] = TRIP) -> DataFrame:
    corrected = correct_by_transitions(predictions, matrix, s, lane)
    return normalise_names(fusion_segments(sliding_majority_vote(corrected, s=s, lane=lane), lane))


def time_per_mode(predictions: DataFrame) -> DataFrame:
    """(user_id, mode, us, pct) of travel time."""
    used = predictions.groupBy("user_id", "mode").agg(F.sum(F.col("t_end") - F.col("t_start")).alias("us"))
    total = F.sum("us").over(Window.partitionBy("user_id"))
    return used.withColumn("pct", F.when(total > 0, 100.0 * F.col("us") / total))


def compare_predictions(predictions: DataFrame, displacements: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each declared trip's set of modes; a trip
    whose declared mode has no canonical name is left out."""
    declared = declared_modes(displacements).withColumn("declared", canonical(F.col("mode_1"))).where("declared IS NOT NULL").groupBy("user_id", "trip_id").agg(F.collect_set("declared").alias("d"))
    predicted = predictions.groupBy("user_id", "trip_id").agg(F.collect_set("mode").alias("m"))
    both = predicted.join(declared, ["user_id", "trip_id"]).withColumn("hits", F.size(F.array_intersect("m", "d")))
    p, r = F.col("hits") / F.size("m"), F.col("hits") / F.size("d")
    return both.select("user_id", "trip_id", p.alias("precision"), r.alias("recall"), F.when(F.col("hits") > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def time_by_pair(predictions: DataFrame, displacements: DataFrame, tasks: int | None = None) -> DataFrame:
    """(user_id, trip_id, predicted, declared, us): how long each pair of modes held
    in each declared window; predicted is null where nothing is, declared where the
    mode has no canonical name. The times of a trip sum to its window.

    A sweep: starts and ends of both kinds of spans in order of time, one sort by
    user; between two of them the last of each kind tells what holds."""
    windows = disjoint_windows(displacements).join(displacements.select("user_id", "blk", "mode_1"), ["user_id", "blk"])
    declared = windows.select("user_id", "t_start", "t_end", F.lit("d").alias("side"), F.struct(trip_name("D", "blk").alias("trip_id"), canonical(F.col("mode_1")).alias("mode")).alias("is"))
    predicted = predictions.select("user_id", "t_start", "t_end", F.lit("p").alias("side"), F.struct(F.lit(None).cast("string").alias("trip_id"), "mode").alias("is"))
    spans = declared.unionByName(predicted).where("t_start < t_end")
    ends = F.explode(F.array(F.struct(F.col("t_start").alias("t"), F.lit(1).alias("starts")), F.struct(F.col("t_end").alias("t"), F.lit(0).alias("starts"))))
    marks = spans.select("user_id", "side", "is", ends.alias("e")).select("user_id", "e.t", "e.starts", "side", F.when(F.col("e.starts") == 1, F.col("is")).alias("is"))
    marks, w = dealt(marks, tasks, "user_id"), Window.partitionBy("user_id").orderBy("t", "starts", "side")  # ends come before starts

    def holds(side: str) -> Column:
        return F.last(F.when(F.col("side") == side, F.struct("is")), ignorenulls=True).over(w)["is"]

    swept = marks.select("user_id", holds("p")["mode"].alias("predicted"), holds("d").alias("d"), (F.lead("t").over(w) - F.col("t")).alias("us"))
    held = swept.where("us > 0 AND d IS NOT NULL")
    return held.groupBy("user_id", F.col("d.trip_id").alias("trip_id"), "predicted", F.col("d.mode").alias("declared")).agg(F.sum("us").alias("us"))


def compare_by_time(predictions: DataFrame, displacements: DataFrame, tasks: int | None = None) -> DataFrame:
    """Precision, recall and F1 of each declared trip by time: the share of the
    predicted time, and of the declared time, in which both modes are the same. Trips
    without a canonical mode, or without predicted time, are left out."""
    pairs = time_by_pair(predictions, displacements, tasks).where("declared IS NOT NULL")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("us")).otherwise(0))

    sums = pairs.groupBy("user_id", "trip_id").agg(F.sum("us").alias("declared_us"), total(F.col("predicted").isNotNull()).alias("predicted_us"), total(F.col("predicted") == F.col("declared")).alias("hit_us"))
    p, r = F.col("hit_us") / F.col("predicted_us"), F.col("hit_us") / F.col("declared_us")
    return sums.where("predicted_us > 0").select("user_id", "trip_id", "declared_us", "predicted_us", "hit_us", p.alias("precision"), r.alias("recall"), F.when(F.col("hit_us") > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def traveller_info(users: DataFrame, individuals: DataFrame) -> DataFrame:
    """(user_id, sex, age, diploma) of each user, nulls where unknown."""
    return users.select("user_id").distinct().join(individuals, "user_id", "left")
