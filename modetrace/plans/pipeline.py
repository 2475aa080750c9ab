"""The batch run: split, train, analyse, with every documented output."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from modetrace.config import DEFAULTS, Settings
from modetrace.operators import analyse, clean, labels, model, postprocess, segment, trips
from modetrace.operators.features import features
from modetrace.sources import render, writers
from modetrace.sources.scratch import discard, materialise


def segment_features(points: DataFrame, displacements: DataFrame, method: str = "v1", s: Settings = DEFAULTS, stays: bool = True) -> DataFrame:
    """Clean, cut into trips and segments, and describe each segment."""
    return features(segment.segments(trips.trips(clean.clean(points, s), displacements, s, stays), method, s), s)


def train(points: DataFrame, displacements: DataFrame, out: str, method: str = "v1", s: Settings = DEFAULTS):
    """Write the split, the training table and the fitted forest. The users'
    filter comes first, so that only training users' points are cleaned."""
    split = labels.split_users(points, s)
    writers.user_lists(split, out)
    mine = labels.of_split(points, split, "train")
    rows = materialise(labels.build_training(segment_features(mine, displacements, method, s), displacements, None, method), "training")
    writers.training(rows, f"{out}/training.csv", method)
    fitted = model.fit(rows, method, s)
    writers.model(fitted, f"{out}/model_{method}")
    discard(rows)
    return fitted


def analyse_all(spark: SparkSession, points: DataFrame, displacements: DataFrame, individuals: DataFrame, out: str, method: str = "v1", s: Settings = DEFAULTS) -> DataFrame:
    """Predict, smooth and report on the test users; the trips table.
    ``method`` is 'v1' or 'v2' and must be one that ``train`` has run for.
    The maps and figures go to the folder ``out`` on the driver's machine."""
    fitted = writers.load_model(f"{out}/model_{method}")
    split = labels.split_users(points, s)
    described = materialise(segment_features(points, displacements, method, s), "segments")
    predicted = model.predict(labels.of_split(described, split, "test"), fitted, method)
    matrix = postprocess.transition_matrix(model.predict(labels.of_split(described, split, "train"), fitted, method))
    final = materialise(postprocess.post_process(predicted, matrix, s), "final")
    table, changes = analyse.all_trips(final, displacements), analyse.change_points(final)
    writers.trips(table, out)
    writers.change_points(changes, out)
    Path(out).mkdir(parents=True, exist_ok=True)
    render.transition_map(changes, f"{out}/points_changement_map.html")
    render.density_map(analyse.change_density(changes, s), f"{out}/heatmap_transitions.html")
    render.transition_figure(analyse.transition_histogram(changes), f"{out}/analyse_transitions.png")
    render.demographic_figure(analyse.modal_splits(final, individuals, s), f"{out}/analyse_demographique_transport.png")
    discard(described)
    return table
