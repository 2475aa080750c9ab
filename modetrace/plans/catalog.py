"""The queries by name. Each builds its own plan from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modetrace.operators import analyse as A
from modetrace.operators import blocks as B
from modetrace.operators import clean as C
from modetrace.operators import labels as L
from modetrace.operators import model as M
from modetrace.operators import optics as O
from modetrace.operators import postprocess as P
from modetrace.operators import segment as G
from modetrace.operators import sequence as Q
from modetrace.operators import spatial as X
from modetrace.operators import trips as T
from modetrace.operators.features import features
from modetrace.functions.motion import with_motion
from modetrace.sources import fixture as fx
from modetrace.sources import layout
from modetrace.sources import writers
from modetrace.sources.deal import dealt, tasks_for
from modetrace.sources.scratch import materialise, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
POINT = ("user_id", "event_id", "t", "lat", "lon")
SEG = ("user_id", "event_id", "trip_id")


class Tables:
    """The steps of the analysis over one set of tables, made when asked for.

    A split of the users is applied to the raw points: everything after it
    works user by user, and a filter doesn't pass below a window by itself.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, source: str = "events"):
        self.spark, self.sf_dir, self.source = spark, sf_dir, source
        self.tasks = fx.tasks(spark, sf_dir, source)
        self.points, self.displacements = (f(spark, sf_dir, source, self.tasks) for f in (fx.gps_points, fx.displacements))
        self.individuals = fx.individuals(spark, sf_dir)

    def valid(self) -> DataFrame:
        return C.in_region(C.in_range(C.drop_missing(self.points)))

    def cleaned(self, split: str | None = None) -> DataFrame:
        return C.clean(self.points if split is None else L.of_split(self.points, self.split(), split))

    def extra(self) -> DataFrame:
        return T.extra_points(self.cleaned(), self.displacements)

    def trips(self, stays: bool = False, split: str | None = None) -> DataFrame:
        return T.trips(self.cleaned(split), self.displacements, stays=stays, tasks=self.tasks)

    def features(self, method: str = "v1", split: str | None = None) -> DataFrame:
        return features(G.segments(self.trips(split=split), method))

    def split(self) -> DataFrame:
        return L.split_users(self.points)

    def training(self, method: str) -> DataFrame:
        return L.build_training(self.features(method, "train"), self.displacements, None, method)

    def rule(self, split: str | None = None) -> DataFrame:
        return M.rule_predict(self.features(split=split))

    def matrix(self) -> DataFrame:
        return P.transition_matrix(self.rule("train"))

    def predicted(self) -> DataFrame:
        """Predictions of all users with their split, from one pass over the points,
        written for what reads it more than once."""
        return materialise(self.rule().join(self.split(), "user_id"), "predicted")

    def post(self) -> DataFrame:
        """Smoothed predictions of the test users: the matrix comes from the one part
        of what was written, the predictions are the other."""
        all_users = self.predicted()
        all_users = dealt(all_users, tasks_for(self.spark, all_users.count()), *P.TRIP)
        train, test = (all_users.where(F.col("split") == x).drop("split") for x in ("train", "test"))
        return P.post_process(test, P.transition_matrix(train))

    def kept_post(self) -> DataFrame:
        """The same, written for what reads it more than once."""
        return materialise(self.post(), "post")

    def changes(self) -> DataFrame:
        return A.change_points(self.post())

    def kept_changes(self) -> DataFrame:
        return materialise(self.changes(), "changes")

    def stored_features(self, method: str = "v1") -> DataFrame:
        """``features`` that start from the stored table."""
        points = layout.stored(self.spark, layout.store(self.points, self.displacements))
        return features(G.segments(T.trips_of(points), method))

    def long_features(self, method: str = "v1", split: str | None = None) -> DataFrame:
        """``features`` with a user's points dealt out by blocks of time."""
        points = self.points if split is None else L.of_split(self.points, self.split(), split)
        return features(B.segmented(points, self.displacements, method, tasks=self.tasks))

    def long_post(self) -> DataFrame:
        """``post`` with trips dealt out by blocks; one pass over all users' points."""
        predicted = materialise(M.rule_predict(self.long_features()).join(self.split(), "user_id"), "predicted")
        train, test = (predicted.where(F.col("split") == x).drop("split") for x in ("train", "test"))
        return B.post(test, B.transition_matrix(train))

    def forest(self, method: str = "v1"):
        """The model of these tables, fitted and saved once a session."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, self.source, method)
        if key not in _MODELS:
            path = shared_folder(self.spark, "model")
            writers.model(M.fit(materialise(self.training(method), "training"), method), path)
            _MODELS[key] = path
        return writers.load_model(_MODELS[key])

    def test_features(self, method: str = "v1") -> DataFrame:
        return self.features(method, "test")


#: Where the session's models were saved.
_MODELS: dict[tuple[str, str, str, str], str] = {}


def _q(build: Callable[[Tables], DataFrame], source: str = "events") -> Query:
    return lambda spark, sf_dir: build(Tables(spark, sf_dir, source))


def _rides(build: Callable[[Tables], DataFrame]) -> Query:
    """Over rides, where trips have several modes."""
    return _q(build, "rides")


def _motion(column: str) -> Query:
    return _q(lambda t: with_motion(t.cleaned(), "user_id").select("user_id", "event_id", column))


def _feature(column: str) -> Query:
    return _q(lambda t: t.features().select("user_id", "trip_id", "seg_id", column))


def _proba(t: Tables) -> DataFrame:
    return M.probabilities(t.test_features(), t.forest()).select("user_id", "trip_id", "seg_id", *(c for c in M.RESULT if c.startswith("p_")))


def _nearest(changes: DataFrame) -> DataFrame:
    return O.nearest(changes, changes, ("user_id", "trip_id", "seg_id"))


FEATURES = ("hcr", "sr", "vcr", "v_max", "v_median", "v_p99", "a_max", "share_fast", "share_very_fast", "duration_us", "length_m")

QUERIES: dict[str, Query] = {
    "fx_points": _q(lambda t: t.points),
    "fx_displacements": _q(lambda t: t.displacements),
    "fx_individuals": _q(lambda t: t.individuals),
    "c1_nan": _q(lambda t: C.drop_missing(t.points)),
    "c2_range": _q(lambda t: C.in_range(C.drop_missing(t.points))),
    "c3_region": _q(lambda t: t.valid()),
    "c4_spikes": _q(lambda t: C.drop_spikes(t.valid())),
    "c5_fusion": _q(lambda t: C.merge_close(t.valid())),
    "c5_from_kept": _q(lambda t: C.merge_from_kept(t.valid())),
    "c6_from_kept": _q(lambda t: C.clean(t.points, from_kept=True)),
    "c6_clean": _q(lambda t: t.cleaned()),
    **{k: _motion(c) for k, c in (("k1_distance", "dist_m"), ("k2_delta", "dt_us"), ("k3_speed", "v"), ("k4_accel", "a"), ("k5_heading", "heading"), ("k6_turn", "dh"), ("k7_vrate", "vrate"))},
    "g1_declared": _q(lambda t: T.declared_points(t.cleaned(), t.displacements)),
    "g2_extra": _q(lambda t: t.extra()),
    "g3_gap": _q(lambda t: T.gap_trips(t.extra())),
    "g4_stay": _q(lambda t: T.stay_points(t.cleaned())),
    "g4_stay_trips": _q(lambda t: t.trips(stays=True)),
    "g5_trip_id": _q(lambda t: t.trips()),
    "g6_walk": _q(lambda t: G.label_points(t.trips()).select(*SEG, "label")),
    "g7_runs": _q(lambda t: G.runs(G.label_points(t.trips())).select(*SEG, "run")),
    "g8_sub": _q(lambda t: G.segments(t.trips(), "v1").select(*SEG, "seg_id")),
    "g9_short": _q(lambda t: G.merge_short(G.runs(G.label_points(t.trips()))).select(*SEG, "label", "run")),
    "g10_breaks": _q(lambda t: G.segments(t.trips(), "v2").select(*SEG, "seg_id")),
    "g10_optimal": _rides(lambda t: G.segments(t.trips(), "v2", optimal=True).select(*SEG, "seg_id")),
    "g10_optimal_features": _rides(lambda t: features(G.segments(t.trips(), "v2", optimal=True)).select("user_id", "trip_id", "seg_id", "hcr", "sr", "vcr", "v_max", "a_max")),
    **{f"f{i}_{n}": _feature(n) for i, n in enumerate(FEATURES, 1)},
    "features_v1": _q(lambda t: t.features("v1")),
    "features_v2": _q(lambda t: t.features("v2").select("user_id", "trip_id", "seg_id", "hcr", "sr", "vcr", "v_max", "a_max")),
    "t0_split": _q(lambda t: t.split()),
    "t1_train": _q(lambda t: L.of_split(t.features(), t.split(), "train").select("user_id", "trip_id", "seg_id")),
    "t2_join": _q(lambda t: L.with_declared(t.features(), t.displacements).select("user_id", "trip_id", "seg_id", "mode_1")),
    "t3_map": _q(lambda t: L.declared_modes(t.displacements).withColumn("mode", L.canonical(F.col("mode_1")))),
    "t4_other": _q(lambda t: L.declared_modes(t.displacements).select("user_id", "trip_id", L.canonical(F.col("mode_1")).alias("mode")).where("mode IS NOT NULL")),
    "t5_training_v1": _q(lambda t: t.training("v1")),
    "t5_training_v2": _q(lambda t: t.training("v2")),
    "m1_forest": _q(lambda t: M.predict(t.test_features(), t.forest()).groupBy("mode").agg(F.count("*").alias("n"))),
    "m3_proba": _q(_proba),
    "m4_pred": _q(lambda t: M.predict(t.test_features(), t.forest()).select("user_id", "trip_id", "seg_id", "mode", "confidence")),
    "m5_df_res": _q(lambda t: M.predict(t.test_features(), t.forest()).withColumns({"TIMESTAMP": F.timestamp_micros("t_start"), "TIMESTAMP_FIN": F.timestamp_micros("t_end")}).drop("t_start", "t_end")),
    "m5_df_res_v2": _q(lambda t: M.predict(t.test_features("v2"), t.forest("v2"), "v2")),
    "m7_rule": _q(lambda t: t.rule()),
    "p1_matrix": _q(lambda t: t.matrix()),
    "p2_correct": _q(lambda t: P.correct_by_transitions(t.rule("test"), t.matrix())),
    "p2_sequence": _rides(lambda t: Q.correct_by_sequence(t.rule("test"), t.matrix())),
    "p2_sequence_events": _q(lambda t: Q.correct_by_sequence(t.rule("test"), t.matrix())),
    "p3_vote": _q(lambda t: P.sliding_majority_vote(t.rule("test"))),
    "p4_fusion": _q(lambda t: P.fusion_segments(t.rule("test"))),
    "p5_names": _q(lambda t: P.normalise_names(t.rule("test"))),
    "p6_time": _q(lambda t: P.time_per_mode(t.post())),
    "p7_metrics": _q(lambda t: P.compare_predictions(t.post(), t.displacements)),
    "p7_pairs": _rides(lambda t: P.time_by_pair(t.post(), t.displacements, t.tasks)),
    "p7_time": _rides(lambda t: P.compare_by_time(t.post(), t.displacements, t.tasks)),
    "p7_time_events": _q(lambda t: P.compare_by_time(t.post(), t.displacements, t.tasks)),
    "p8_info": _q(lambda t: P.traveller_info(t.points, t.individuals)),
    "p9_radius": _rides(lambda t: X.radius_counts(t.kept_changes())),
    "p9_clusters": _rides(lambda t: X.clusters(t.kept_changes())),
    "p9_spatial": _rides(lambda t: X.spatial_post_process(t.rule("test"), t.kept_changes())),
    "p9_optics": _rides(lambda t: O.clusters_at(t.kept_changes(), (60.0, 200.0, 450.0))),
    "p9_nearest": _rides(lambda t: _nearest(t.kept_changes())),
    "p10_post": _q(lambda t: t.post()),
    "a1_test": _q(lambda t: t.rule("test")),
    "a3_changes": _rides(lambda t: t.changes()),
    "a4_declared": _q(lambda t: A.declared_trips(t.kept_post(), t.displacements)),
    "a5_trips": _q(lambda t: A.all_trips(t.kept_post(), t.displacements)),
    "a6_histogram": _rides(lambda t: A.transition_histogram(t.changes())),
    "a7_matrix": _rides(lambda t: A.observed_matrix(t.changes())),
    "a8_density": _rides(lambda t: A.change_density(t.changes())),
    "s9_pyramid": _rides(lambda t: A.tile_pyramid(A.transition_labels(t.changes()), "kind")),
    "s10_pyramid": _rides(lambda t: A.tile_pyramid(t.changes())),
    "a9_labels": _rides(lambda t: A.transition_labels(t.changes()).select("user_id", "trip_id", "seg_id", "t", "kind")),
    "a10_sex": _q(lambda t: A.modal_split(t.post(), t.individuals, "sex")),
    "a11_age": _q(lambda t: A.modal_split(t.post(), t.individuals, "age")),
    "a12_diploma": _q(lambda t: A.modal_split(t.post(), t.individuals, "diploma")),
    "s5_stored_features": _q(lambda t: t.stored_features()),
    "long_features_v1": _rides(lambda t: t.long_features("v1")),
    "long_features_v2": _rides(lambda t: t.long_features("v2").select("user_id", "trip_id", "seg_id", "hcr", "sr", "vcr", "v_max", "a_max")),
    "long_post": _rides(lambda t: t.long_post()),
    "a10_a12_splits": _q(lambda t: A.modal_splits(t.post(), t.individuals)),
    "rides_points": _rides(lambda t: t.points),
    "rides_displacements": _rides(lambda t: t.displacements),
    "rides_matrix": _rides(lambda t: t.matrix()),
    "rides_post": _rides(lambda t: t.post()),
    "rides_metrics": _rides(lambda t: P.compare_predictions(t.post(), t.displacements)),
    "rides_trips": _rides(lambda t: A.all_trips(t.kept_post(), t.displacements)),
}
