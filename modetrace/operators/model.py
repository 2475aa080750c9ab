"""The random forest, and a rule classifier whose results SQL can repeat."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modetrace.config import CANONICAL, DEFAULTS, Settings
from modetrace.operators.features import feature_names

RESULT = ("user_id", "trip_id", "kind", "seg_id", "mode", "confidence", *(f"p_{m.lower()}" for m in CANONICAL), "lat", "lon", "t_start", "t_end")
#: Greatest speed (m/s) of a segment, its mode and how sure that is; then the rest.
RULES = ((2.5, "WALK", 0.9), (7.0, "CYCLING", 0.7), (14.0, "BUS", 0.5), (22.0, "CAR", 0.6), (30.0, "TRAMWAY", 0.4), (40.0, "SUBWAY", 0.55))
REST, UNKNOWN = ("TRAIN", 0.8), ("WALK", 0.3)


def check_features(df: DataFrame, method: str) -> None:
    missing = [c for c in feature_names(method) if c not in df.columns]
    if missing:
        raise ValueError(f"not in index: {missing}; method {method} needs {list(feature_names(method))}")


def _filled(df: DataFrame, method: str) -> DataFrame:
    """Features without a value (no speed, no length) read as -1."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in feature_names(method)})


def fit(training: DataFrame, method: str = "v1", s: Settings = DEFAULTS) -> PipelineModel:
    """Fit the documented forest once; save it with ``model.write()``. The
    forest samples by partition, so rows get a fixed place first. ``training`` is
    read several times: pass a table that is written or cached."""
    check_features(training, method)
    partitions = 8 + training.count() // s.rows_a_fit_partition
    rows = _filled(training, method).repartition(partitions, "user_id").sortWithinPartitions("user_id", "trip_id", "seg_id")
    indexer = StringIndexer(inputCol="mode", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    assembler = VectorAssembler(inputCols=list(feature_names(method)), outputCol="features", handleInvalid="keep")
    forest = RandomForestClassifier(numTrees=s.trees, maxDepth=s.depth, minInstancesPerNode=s.leaf, subsamplingRate=s.sample, seed=s.seed)
    name = IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels)
    return Pipeline(stages=[indexer, assembler, forest, name]).fit(rows)


def probabilities(features: DataFrame, model: PipelineModel, method: str = "v1") -> DataFrame:
    """Features with p_<mode>; modes the training data lacks get 0."""
    check_features(features, method)
    filled = _filled(features.drop("mode"), method)
    scored = PipelineModel(model.stages[1:]).transform(filled).withColumn("p", vector_to_array("probability"))
    labels = model.stages[0].labels
    out = {f"p_{m.lower()}": F.col("p")[labels.index(m)] if m in labels else F.lit(0.0) for m in CANONICAL}
    return scored.withColumns(out).drop("features", "rawPrediction", "probability", "p", "prediction")


def predict(features: DataFrame, model: PipelineModel, method: str = "v1") -> DataFrame:
    """One row a segment: mode, confidence, probabilities, position, times."""
    scored = probabilities(features, model, method)
    best = F.greatest(*(F.col(f"p_{m.lower()}") for m in CANONICAL))
    return scored.withColumn("mode", F.col("predicted")).withColumn("confidence", best).select(*RESULT)


def rule_predict(features: DataFrame) -> DataFrame:
    """The same columns from speed alone; the rest of the confidence is
    shared by the other modes."""
    v = F.col("v_max")
    known = reduce(lambda c, r: c.when(v <= r[0], F.struct(F.lit(r[1]).alias("mode"), F.lit(r[2]).alias("confidence"))), RULES, F.when(v.isNull(), F.struct(F.lit(UNKNOWN[0]).alias("mode"), F.lit(UNKNOWN[1]).alias("confidence"))))
    judged = features.withColumn("r", known.otherwise(F.struct(F.lit(REST[0]).alias("mode"), F.lit(REST[1]).alias("confidence"))))
    judged = judged.withColumns({"mode": F.col("r.mode"), "confidence": F.col("r.confidence")})
    p = {f"p_{m.lower()}": F.when(F.col("mode") == m, F.col("confidence")).otherwise((1 - F.col("confidence")) / 6) for m in CANONICAL}
    return judged.withColumns(p).select(*RESULT)
