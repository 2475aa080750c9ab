"""Trips, change points, transitions and modal shares for reporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modetrace.config import CANONICAL, DEFAULTS, Settings
from modetrace.operators.labels import canonical, declared_modes
from modetrace.operators.postprocess import by_segment, compare_predictions, time_per_mode


def change_points(predictions: DataFrame) -> DataFrame:
    """(user_id, trip_id, seg_id, t, lat, lon, prev, mode) at each change of mode."""
    return predictions.withColumn("prev", F.lag("mode").over(by_segment())).where("prev <> mode").select("user_id", "trip_id", "seg_id", F.col("t_start").alias("t"), "lat", "lon", "prev", "mode")


def _trip_rows(predictions: DataFrame, kind: str) -> DataFrame:
    start = F.timestamp_micros(F.min("t_start"))
    return (
        predictions.where(F.col("kind") == kind)
        .groupBy("user_id", "trip_id", "kind")
        .agg(F.date_format(start, "yyyy-MM-dd").alias("date"), F.hour(start).alias("hour"), F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.concat_ws("|", F.sort_array(F.collect_set("mode"))).alias("predicted"))
    )


def declared_trips(predictions: DataFrame, displacements: DataFrame) -> DataFrame:
    """A row a declared trip: when, predicted and declared modes, metrics
    (null where the declared mode has no canonical name)."""
    declared = declared_modes(displacements).select("user_id", "trip_id", canonical(F.col("mode_1")).alias("declared"))
    rows = _trip_rows(predictions, "declared").join(declared, ["user_id", "trip_id"], "left")
    return rows.join(compare_predictions(predictions, displacements), ["user_id", "trip_id"], "left")


def extra_trips(predictions: DataFrame) -> DataFrame:
    return _trip_rows(predictions, "extra")


def all_trips(predictions: DataFrame, displacements: DataFrame) -> DataFrame:
    return declared_trips(predictions, displacements).unionByName(extra_trips(predictions), allowMissingColumns=True)


def transition_histogram(changes: DataFrame) -> DataFrame:
    return changes.groupBy("prev", "mode").agg(F.count("*").alias("n"))


def observed_matrix(changes: DataFrame) -> DataFrame:
    """One row a mode before, one column a mode after."""
    counted = changes.groupBy("prev").pivot("mode", list(CANONICAL)).agg(F.count(F.lit(1)))
    return counted.select("prev", *(F.coalesce(m, F.lit(0)).cast("long").alias(f"to_{m.lower()}") for m in CANONICAL))


def change_density(changes: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    cell = [F.floor(F.col(c) * s.cells_per_degree).alias(f"{c}_cell") for c in ("lat", "lon")]
    return changes.select(*cell).groupBy("lat_cell", "lon_cell").agg(F.count("*").alias("n"))


def morton(y: Column, x: Column, bits: int) -> Column:
    """The bits of two numbers in turn, y's first: a cell's code less its last two
    bits is the code of the cell around it, of twice the side."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        for value, place in ((x, 2 * i), (y, 2 * i + 1)):
            out = out + F.shiftleft(F.shiftright(value, i).bitwiseAND(1), place)
    return out


def tile_pyramid(changes: DataFrame, *by: str, s: Settings = DEFAULTS) -> DataFrame:
    """(level, code, by..., n) of the cells with change points at every level from 0, the
    whole region, to tile_bits. The finest cells are counted first; each then counts for
    the prefixes of its code, so that every level sums to all changes."""
    side = 1 << s.tile_bits

    def place(column: str, bounds: tuple[float, float]) -> Column:
        share = (F.col(column) - bounds[0]) / (bounds[1] - bounds[0])
        return F.greatest(F.lit(0).cast("long"), F.least(F.lit(side - 1).cast("long"), F.floor(share * side)))

    finest = changes.select(morton(place("lat", s.lat), place("lon", s.lon), s.tile_bits).alias("code"), *by).groupBy("code", *by).agg(F.count("*").alias("n"))
    levels = finest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(s.tile_bits))))
    prefix = F.expr(f"shiftright(code, 2 * ({s.tile_bits} - level))")
    return levels.groupBy("level", prefix.alias("code"), *by).agg(F.sum("n").alias("n"))


def transition_labels(changes: DataFrame) -> DataFrame:
    return changes.withColumn("kind", F.concat_ws("→", "prev", "mode"))


def age_band(age: Column, s: Settings = DEFAULTS) -> Column:
    out = F.when(age.isNull(), "unknown")
    for low, high in zip((0, *s.ages), s.ages, strict=False):
        out = out.when(age < high, f"{low}-{high - 1}")
    return out.otherwise(f"{s.ages[-1]}+")


def modal_splits(predictions: DataFrame, individuals: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(by, group, mode, us, pct): ``modal_split`` by sex, age and diploma at once, in
    grouping sets over one pass."""
    unknown = {c: F.coalesce(c, F.lit("unknown")) for c in ("sex", "diploma")}
    joined = time_per_mode(predictions).join(individuals, "user_id", "left").withColumns(unknown | {"age": age_band(F.col("age"), s)})
    columns = [F.col(c) for c in ("sex", "age", "diploma")]
    sets = joined.groupingSets([[c, F.col("mode")] for c in columns], *columns, F.col("mode")).agg(F.sum("us").alias("us"), F.grouping_id().alias("gid"))
    # a set's id has a bit for each column that it leaves out, of sex, age, diploma and mode
    by = F.when(F.col("gid") == 0b0110, "sex").when(F.col("gid") == 0b1010, "age").otherwise("diploma")
    named = sets.select(by.alias("by"), F.coalesce("sex", "age", "diploma").alias("group"), "mode", "us")
    total = F.sum("us").over(Window.partitionBy("by", "group"))
    return named.withColumn("pct", F.when(total > 0, 100.0 * F.col("us") / total))


def modal_split(predictions: DataFrame, individuals: DataFrame, by: str, s: Settings = DEFAULTS) -> DataFrame:
    """(group, mode, us, pct): share of travel time by sex, age or diploma."""
    group = age_band(F.col("age"), s) if by == "age" else F.coalesce(F.col(by), F.lit("unknown"))
    joined = time_per_mode(predictions).join(individuals, "user_id", "left").withColumn("group", group)
    used = joined.groupBy("group", "mode").agg(F.sum("us").alias("us"))
    total = F.sum("us").over(Window.partitionBy("group"))
    return used.withColumn("pct", F.when(total > 0, 100.0 * F.col("us") / total))
