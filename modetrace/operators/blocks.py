"""The same steps for very long traces: a user is many tasks.

Elsewhere a user's points are one window partition. Here they are dealt out by blocks
of time, and what a window needs from outside its block is brought to it:

* a neighbour's values: the last row of the block before and the first of the one after;
* a halo of rows, where a step looks back or ahead several rows in a row;
* totals and last values of all blocks before, for running counts.

Each comes from a table of one row, or few, for a block: only that table is in order
by user. Points go through two exchanges, by user and block and by trip and block, and
are written once, in between. The rows are those of the steps by user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modetrace.config import DEFAULTS, Settings
from modetrace.functions.motion import by_time, distance_m
from modetrace.operators.clean import drop_missing, in_range, in_region
from modetrace.operators.postprocess import by_segment, matrix_of, post_process
from modetrace.operators.segment import TRIP, label_points, smoothed, speed_break
from modetrace.operators.trips import POINT, disjoint_windows, trip_name
from modetrace.sources.deal import dealt, tasks_for
from modetrace.sources.scratch import materialise

USER = ("user_id",)
ORDER, SEGMENT = ("t", "event_id"), ("t_start", "seg_id")
#: Rows before and after a block that segments look at.
BACK, AHEAD = 3, 1


def with_block(rows: DataFrame, s: Settings = DEFAULTS, time: str = "t") -> DataFrame:
    return rows.withColumn("block", F.expr(f"{time} div {s.block_us}"))


def _inside(lane: tuple[str, ...], order: tuple[str, ...] = ORDER):
    return Window.partitionBy(*lane, "block").orderBy(*order)


def _blocks(lane: tuple[str, ...]):
    return Window.partitionBy(*lane).orderBy("block")


def _earlier(lane: tuple[str, ...]):
    return _blocks(lane).rowsBetween(Window.unboundedPreceding, -1)


def with_neighbours(rows: DataFrame, lane: tuple[str, ...], order: tuple[str, ...] = ORDER, tasks: int | None = None) -> DataFrame:
    """Rows with ``before`` and ``after``, the structs of all columns of the rows
    next to them in the lane, in whatever block those are."""
    columns = [c for c in rows.columns if c not in lane]
    row = F.struct(*order, *(c for c in columns if c not in order))
    rows = dealt(rows, tasks, *lane, "block")
    ends = rows.groupBy(*lane, "block").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    outside = ends.select(*lane, "block", F.lag("last").over(_blocks(lane)).alias("block_before"), F.lead("first").over(_blocks(lane)).alias("block_after"))
    w = _inside(lane, order)
    near = {"before": F.coalesce(F.lag(row).over(w), "block_before"), "after": F.coalesce(F.lead(row).over(w), "block_after")}
    return rows.join(outside, [*lane, "block"]).withColumns(near).drop("block_before", "block_after")


def with_running(rows: DataFrame, lane: tuple[str, ...], counts: dict[str, Column], lasts: dict[str, Column] | None = None) -> DataFrame:
    """Rows with running counts of conditions, and the last values that are not
    null, both up to the row and over all blocks of the lane. ``<name>_before`` is the
    same up to the end of the block before."""
    lasts, w = lasts or {}, _inside(lane)
    local = rows.withColumns({f"__{n}": F.when(c, 1).otherwise(0) for n, c in counts.items()} | {f"__{n}": c for n, c in lasts.items()})
    totals = local.groupBy(*lane, "block").agg(*(F.sum(f"__{n}").alias(f"__{n}") for n in counts), *(F.max(F.when(F.col(f"__{n}").isNotNull(), F.struct(*ORDER, f"__{n}"))).alias(f"__{n}") for n in lasts))
    carried = [F.coalesce(F.sum(f"__{n}").over(_earlier(lane)), F.lit(0)).alias(f"{n}_before") for n in counts] + [F.last(f"__{n}", ignorenulls=True).over(_earlier(lane))[f"__{n}"].alias(f"{n}_before") for n in lasts]
    joined = local.join(totals.select(*lane, "block", *carried), [*lane, "block"])
    now = {n: F.col(f"{n}_before") + F.sum(f"__{n}").over(w) for n in counts} | {n: F.coalesce(F.last(f"__{n}", ignorenulls=True).over(w), f"{n}_before") for n in lasts}
    return joined.withColumns(now).drop(*(f"__{n}" for n in (*counts, *lasts)))


def with_halo(rows: DataFrame, lane: tuple[str, ...], back: int, ahead: int, order: tuple[str, ...] = ORDER, edge: Column | None = None, tasks: int | None = None) -> DataFrame:
    """Rows, and in each block copies (``own`` is false) of the ``back`` rows before
    it and the ``ahead`` rows after it. ``edge`` tells rows that may be among the
    first ``ahead`` or last ``back`` of their block, if that is known."""
    columns, w = rows.columns, Window.partitionBy(*lane).orderBy(*order)
    if edge is None:
        rows, edge = with_edges(rows, lane, back, ahead, order), F.col("edge")
    rest = Window.partitionBy(*lane)
    near = dealt(rows.where(edge).select(*columns), tasks, *lane).withColumn("__many", F.max("block").over(rest) != F.min("block").over(rest)).where("__many")
    row = F.struct(*columns)
    # neighbours of another block, in order, are what lies next to a block
    starts, ends = F.lag("block").over(w) != F.col("block"), F.lead("block").over(w) != F.col("block")
    halo = near.select(
        F.col("block").alias("__block"),
        F.when(starts, F.collect_list(row).over(w.rowsBetween(-back, -1))).alias("__back"),
        F.when(ends, F.collect_list(row).over(w.rowsBetween(1, ahead))).alias("__ahead"),
    )
    none = F.expr("array()").cast(rows.select(F.array(row)).schema[0].dataType)
    copies = halo.select("__block", F.explode(F.concat(F.coalesce("__back", none), F.coalesce("__ahead", none))).alias("r"))
    copies = copies.select(*(F.col("__block").alias(c) if c == "block" else F.col(f"r.{c}").alias(c) for c in columns), F.lit(False).alias("own"))
    return rows.select(*columns, F.lit(True).alias("own")).unionByName(copies)


def with_edges(rows: DataFrame, lane: tuple[str, ...], back: int, ahead: int, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Rows with ``edge``: among the first ``ahead`` or last ``back`` of the block."""
    w = _inside(lane, order)
    last = Window.partitionBy(*lane, "block").orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("edge", (F.row_number().over(w) <= ahead) | (F.row_number().over(last) <= back))


def _speed(a: str | None, b: str | None) -> tuple[Column, Column, Column]:
    """Metres, microseconds and m/s from row a to row b, this row where None."""
    lat1, lon1, t1, lat2, lon2, t2 = (F.col(f"{x}.{c}" if x else c) for x in (a, b) for c in ("lat", "lon", "t"))
    metres, us = distance_m(lat1, lon1, lat2, lon2), t2 - t1
    return metres, us, F.when(us > 0, metres / (us / 1e6))


def clean(points: DataFrame, s: Settings = DEFAULTS, tasks: int | None = None) -> DataFrame:
    """``clean.clean``, with the block of each point."""
    valid = with_block(in_region(in_range(drop_missing(points)), s).select(*POINT), s)
    columns = valid.columns
    near = with_neighbours(valid, USER, tasks=tasks)
    spike = F.coalesce((_speed("before", None)[2] > s.spike_mps) & (_speed(None, "after")[2] > s.spike_mps), F.lit(False))
    calm = with_neighbours(near.where(~spike).select(*columns), USER, tasks=tasks)
    metres, us, _ = _speed("before", None)
    return calm.where(~F.coalesce((metres < s.merge_m) & (us < s.merge_s * 1_000_000), F.lit(False))).select(*columns)


def with_windows(points: DataFrame, displacements: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Points with blk of the declared window that they lie in. Each block gets the
    windows that reach into it, of the blocks that its user has."""
    span = points.groupBy("user_id").agg(F.min("block").alias("b0"), F.max("block").alias("b1"))
    block = [F.expr(f"{c} div {s.block_us}") for c in ("t_start", "t_end")]
    reach = disjoint_windows(displacements).join(span, "user_id").withColumns({"b0": F.greatest(block[0], "b0"), "b1": F.least(block[1], "b1")}).where("b0 <= b1")
    of_block = reach.withColumn("block", F.explode(F.sequence("b0", "b1"))).groupBy("user_id", "block").agg(F.collect_list(F.struct("t_start", "t_end", "blk")).alias("windows"))
    inside = F.filter("windows", lambda x: (x["t_start"] <= F.col("t")) & (F.col("t") <= x["t_end"]))
    return points.join(of_block, ["user_id", "block"], "left").withColumn("blk", F.get(inside, F.lit(0))["blk"]).drop("windows")


def trips(points: DataFrame, displacements: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """``trips.trips`` without stays, of ``clean``'s points, with their block."""
    found, w = with_windows(points, displacements, s), _inside(USER)
    extra, gap = F.col("blk").isNull(), s.gap_s * 1_000_000
    last = F.last(F.when(extra, F.col("t")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    local = found.withColumn("cut", F.when(extra & (F.col("t") - last > gap), 1).otherwise(0))
    own = [F.when(extra, F.col("t"))] * 2
    ends = local.groupBy("user_id", "block").agg(F.min(own[0]).alias("t0"), F.max(own[1]).alias("t1"), F.sum("cut").alias("cuts"))
    first = F.when(F.col("t0") - F.last("t1", ignorenulls=True).over(_earlier(USER)) > gap, 1).otherwise(0)  # the block's first extra point cuts
    numbers = ends.withColumn("first", first).select("user_id", "block", (F.coalesce(F.sum(F.col("cuts") + F.col("first")).over(_earlier(USER)), F.lit(0)) + F.col("first")).alias("base"))
    numbered = local.join(numbers, ["user_id", "block"]).withColumn("n", F.col("base") + F.sum("cut").over(w))
    return numbered.select(*POINT, "block", F.when(extra, "extra").otherwise("declared").alias("kind"), F.when(extra, trip_name("E", "n")).otherwise(trip_name("D", "blk")).alias("trip_id"))


def segments(found: DataFrame, method: str = "v1", s: Settings = DEFAULTS, tasks: int | None = None) -> DataFrame:
    """``segment.segments`` of trips with a block, and ``edge`` for BACK and AHEAD."""
    lane = (*TRIP, "block")
    around = with_halo(found.drop("edge"), TRIP, BACK, AHEAD, tasks=tasks) if "edge" not in found.columns else with_halo(found, TRIP, BACK, AHEAD, edge=F.col("edge"), tasks=tasks).drop("edge")
    around, w = dealt(around, tasks, *lane), by_time(*lane)
    if method == "v2":
        cut = smoothed(around, s, lane).withColumn("__cut", F.coalesce(speed_break(w, s), F.lit(False))).where("own").drop("own", "mmps", "smooth")
        return with_running(cut, TRIP, {"seg_id": F.col("__cut")}).drop("__cut", "seg_id_before", "block")
    if method != "v1":
        raise ValueError(f"method is 'v1' or 'v2', not {method!r}")
    labelled = label_points(around, s, lane)
    before = F.lag("label").over(w)
    flagged = labelled.withColumns({"__starts": F.coalesce(F.col("label") != before, F.lit(False)), "__begins": F.coalesce(F.col("label") != before, F.lit(True))}).where("own").drop("own")
    run = with_running(flagged, TRIP, {"run": F.col("__starts")}, {"since": F.when(F.col("__begins"), F.col("t")), "now": F.col("t")})

    def sub(t, since):
        return F.floor((F.col(t) - F.col(since)) / (s.max_segment_s * 1_000_000))

    run = run.withColumn("sub", sub("t", "since"))
    here = _inside(TRIP)
    old_run, old_sub = F.coalesce(F.lag("run").over(here), F.when(F.col("now_before").isNotNull(), F.col("run_before"))), F.coalesce(F.lag("sub").over(here), sub("now_before", "since_before"))
    cut = run.withColumn("__cut", F.coalesce((F.col("run") != old_run) | (F.col("sub") != old_sub), F.lit(False)))
    extra = [f"{n}_before" for n in ("run", "since", "now", "seg_id")]
    return with_running(cut.drop(*extra), TRIP, {"seg_id": F.col("__cut")}).drop("__starts", "__begins", "__cut", "since", "now", "block", *extra)


def segmented(points: DataFrame, displacements: DataFrame, method: str = "v1", s: Settings = DEFAULTS, tasks: int | None = None) -> DataFrame:
    """Cleaned points in trips and segments. The trips are written once. ``tasks`` is
    how many the points are dealt out to, if not as Spark does it."""
    cleaned = dealt(materialise(clean(points, s, tasks), "cleaned"), tasks, "user_id", "block")
    found = with_edges(trips(cleaned, displacements, s), TRIP, BACK, AHEAD)
    return segments(materialise(found, "trips"), method, s, tasks)


def transition_matrix(predictions: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    around = with_halo(with_block(predictions, s, "t_start"), TRIP, 1, 1, SEGMENT)
    return matrix_of(around.select("own", F.lag("mode").over(by_segment((*TRIP, "block"))).alias("prev"), F.col("mode").alias("next")).where("own").drop("own"))


def post(predictions: DataFrame, matrix: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """``postprocess.post_process`` with a trip dealt out by blocks: smoothing looks
    back over ``vote // 2 + 2`` segments (the vote, the fusion and the transition
    before) and ahead over one less."""
    columns, half = predictions.columns, s.vote // 2
    around = with_halo(with_block(predictions, s, "t_start"), TRIP, half + 2, half + 1, SEGMENT)
    around = dealt(around, tasks_for(predictions.sparkSession, predictions.count()), *TRIP, "block")
    return post_process(around, matrix, s, (*TRIP, "block")).where("own").select(*columns)
