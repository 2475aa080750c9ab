"""Sequence decoding: the modes of weak predictions that fit a trip best as a whole.

Segments that are predicted with confidence keep their modes. Between two of them a
run of weak ones takes the modes with the greatest product of their probabilities and
of all transitions, those to the sure neighbours included: max-product dynamic
programming with back-pointers, as a fold over the run's ordered segments in the JVM.
What is sure cuts a trip into independent runs, so a long trip is many rows.

Products are sums of logarithms in whole millionths, so that equal ones are equal;
what is rarer than ``unseen`` counts as that. Of equal sequences the one with the
later names wins, looked at from the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modetrace.config import CANONICAL, DEFAULTS, Settings
from modetrace.operators.postprocess import TRIP, by_segment

_STATES = range(len(CANONICAL))
#: Bits of a back-pointer; those of a step are one number.
_BITS = 3


def micro_log(p: Column, s: Settings = DEFAULTS) -> Column:
    return F.round(F.ln(F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(s.unseen))) * 1_000_000).cast("long")


def _table(matrix: DataFrame, s: Settings) -> DataFrame:
    """One row: log transitions as an array by mode before of arrays by mode after."""
    flat = F.map_from_entries(F.collect_list(F.struct(F.concat_ws(">", "prev", "next"), "p")))
    rows = [F.array(*(micro_log(F.try_element_at("all", F.lit(f"{a}>{b}")), s) for b in CANONICAL)) for a in CANONICAL]
    return matrix.agg(flat.alias("all")).select(F.array(*rows).alias("moves"))


def _state(mode: Column) -> Column:
    """The number of a canonical mode, null for another."""
    place = F.array_position(F.array(*map(F.lit, CANONICAL)), mode)
    return F.when(place > 0, (place - 1).cast("int"))


def _best(options: list[Column]) -> Column:
    """The greatest score and its state; of equal ones the last."""
    return F.array_max(F.array(*(F.struct(o.alias("score"), F.lit(k).alias("state")) for k, o in zip(_STATES, options, strict=True))))


def _step(so_far: Column, segment: Column) -> Column:
    bests = [_best([so_far["scores"][k] + F.col("moves")[k][m] for k in _STATES]) for m in _STATES]
    back = sum((F.shiftleft(b["state"].cast("long"), _BITS * m) for m, b in zip(_STATES, bests, strict=True)), F.lit(0).cast("long"))
    return F.struct(
        F.array(*(b["score"] + segment["w"][m] for m, b in zip(_STATES, bests, strict=True))).alias("scores"),
        F.concat(so_far["back"], F.array(back)).alias("back"),
    )


def _path(run: Column) -> Column:
    """The states of a run's segments."""
    edge = F.lit(0).cast("long")
    first = [run[0]["w"][m] + F.coalesce(F.get(F.get("moves", F.col("left")), F.lit(m)), edge) for m in _STATES]
    start = F.struct(F.array(*first).alias("scores"), F.array().cast("array<bigint>").alias("back"))

    def finish(end: Column) -> Column:
        last = _best([end["scores"][m] + F.coalesce(F.get(F.col("moves")[m], F.col("right")), edge) for m in _STATES])["state"]
        trail = F.struct(last.alias("now"), F.array(last).alias("states"))

        def walk(at: Column, back: Column) -> Column:
            before = _bits(back, at["now"])
            return F.struct(before.alias("now"), F.concat(F.array(before), at["states"]).alias("states"))

        return F.aggregate(F.reverse(end["back"]), trail, walk, lambda at: at["states"])

    return F.aggregate(F.slice(run, 2, F.greatest(F.size(run) - 1, F.lit(0))), start, _step, finish)


def _bits(back: Column, state: Column) -> Column:
    """The back-pointer of a state among those of a step."""
    return F.element_at(F.array(*(F.shiftright(back, _BITS * m).bitwiseAND((1 << _BITS) - 1).cast("int") for m in _STATES)), state + 1)


def correct_by_sequence(predictions: DataFrame, matrix: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Predictions in which weak ones have the modes of their trip's best sequence."""
    w = by_segment()
    sure = F.coalesce(F.col("confidence") >= s.tau, F.lit(False)) & _state(F.col("mode")).isNotNull()
    known = F.when(sure, _state(F.col("mode")))
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    marked = predictions.withColumns({"sure": sure, "run": F.sum(F.when(sure, 1).otherwise(0)).over(w), "left": F.last(known, ignorenulls=True).over(before), "right": F.first(known, ignorenulls=True).over(after)})
    weights = F.array(*(micro_log(F.col(f"p_{m.lower()}"), s) for m in CANONICAL))
    row = F.struct("t_start", "seg_id", weights.alias("w"), F.struct(*predictions.columns).alias("row"))
    runs = marked.where("NOT sure").groupBy(*TRIP, "run").agg(F.sort_array(F.collect_list(row)).alias("segments"), F.first("left").alias("left"), F.first("right").alias("right"))
    decoded = runs.crossJoin(F.broadcast(_table(matrix, s)))  # one row
    decoded = decoded.select(F.explode(F.arrays_zip(F.col("segments.row").alias("row"), _path(F.col("segments")).alias("state"))).alias("x")).select("x.row.*", "x.state")
    names = F.array(*map(F.lit, CANONICAL))
    weak = decoded.withColumn("mode", F.element_at(names, F.col("state") + 1)).select(*predictions.columns)
    return marked.where("sure").select(*predictions.columns).unionByName(weak)
