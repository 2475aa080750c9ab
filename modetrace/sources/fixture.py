"""GPS tables derived from the driver's tables: short traces of one speed a
declared trip from ``events``, and rides of several modes from ``lineitem``.

The recipe is SQL in which only the two engines' spellings differ: the epoch
microseconds of a timestamp and integer division.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from modetrace.sources.deal import dealt, tasks_for

SPARK = {"us": "unix_micros(cast(ts as timestamp))", "div": "div"}
DUCKDB = {"us": "epoch_us(ts)", "div": "//"}

TRACE = """
SELECT user_id, event_id, t, rn {div} 10 AS blk, reg, cast(round(value * 100) AS bigint) AS vc,
       coalesce(dts, 0) * CASE reg WHEN 0 THEN 1 WHEN 1 THEN 12 WHEN 2 THEN 70 ELSE 180 END AS st
FROM (
  SELECT user_id, event_id, t, rn, value, (user_id * 7 + rn {div} 10) % 4 AS reg,
         (t - lag(t) OVER (PARTITION BY user_id ORDER BY us, event_id)) {div} 1000000 AS dts,  us
  FROM (
    SELECT user_id, event_id, value, us, 1704067200000000 + (us - 1704067200000000) {div} 240 AS t,
           row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn
    FROM (SELECT user_id, event_id, value, {us} AS us FROM events) e
  ) r
) x
"""

POINTS = """
SELECT user_id, event_id, t,
       CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 103 = 0 THEN 95.0e0 WHEN event_id % 97 = 0 THEN 0.0e0
            WHEN event_id % 31 = 0 THEN (la + 400000) / 1e6 ELSE la / 1e6 END AS lat,
       lo / 1e6 AS lon
FROM (
  SELECT user_id, event_id, t,
         48700000 + sum(CASE vc % 4 WHEN 0 THEN st WHEN 1 THEN -st ELSE 0 END) OVER w AS la,
         2400000 + sum(CASE vc % 4 WHEN 2 THEN st WHEN 3 THEN -st ELSE 0 END) OVER w AS lo
  FROM trace
  WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
) p
"""

DISPLACEMENTS = """
SELECT user_id, blk, min(t) AS t_start, max(t) AS t_end,
       CASE max(reg) WHEN 2 THEN CASE user_id % 5 WHEN 0 THEN 'BUS' WHEN 1 THEN 'BIKE' WHEN 2 THEN 'TRAMWAY' WHEN 3 THEN 'ELECT_BIKE' ELSE 'OTHER' END
                     WHEN 3 THEN CASE user_id % 5 WHEN 0 THEN 'PRIV_CAR_DRIVER' WHEN 1 THEN 'TRAIN' WHEN 2 THEN 'SUBWAY' WHEN 3 THEN 'TWO_WHEELER' ELSE 'TRAIN_EXPRESS' END
                     ELSE 'WALKING' END AS mode_1
FROM trace
WHERE blk % 3 <> 2
GROUP BY user_id, blk
"""

INDIVIDUALS = """
SELECT c_custkey AS user_id, CASE c_nationkey % 2 WHEN 0 THEN 'F' ELSE 'M' END AS sex,
       cast(16 + cast(floor(abs(c_acctbal)) AS bigint) % 70 AS int) AS age, c_mktsegment AS diploma
FROM customer
"""

# Rides: a point each 40 s and an hour's pause each 180 points. Each 45 points the
# speed changes, and the rider goes out and comes back to near the same station.
RIDE_TRACE = """
SELECT user_id, event_id, rn {div} 180 AS blk, reg, w, 1704067200000000 + rn * 40000000 + (rn {div} 180) * 3600000000 AS t,
       CASE WHEN rn % 45 < 22 THEN 1 WHEN rn % 45 < 44 THEN -1 ELSE 0 END
         * (CASE reg WHEN 0 THEN 400 WHEN 1 THEN 1900 WHEN 2 THEN 4000 WHEN 3 THEN 6600 ELSE 9300 END * (90 + w % 20)) {div} 100 AS st
FROM (
  SELECT user_id, user_id * 100000 + rn AS event_id, w, rn, ((rn {div} 45) * (rn {div} 45) * 3 + (rn {div} 45) * user_id + user_id) % 5 AS reg
  FROM (
    SELECT l_suppkey AS user_id, l_partkey AS w, cast(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS bigint) AS rn
    FROM lineitem
  ) r
) x
"""

RIDE_POINTS = """
SELECT user_id, event_id, t,
       CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 103 = 0 THEN 95.0e0 WHEN event_id % 97 = 0 THEN 0.0e0
            WHEN event_id % 89 = 0 THEN (la + 400000) / 1e6 ELSE la / 1e6 END AS lat,
       lo / 1e6 AS lon
FROM (
  SELECT user_id, event_id, t,
         48700000 + (user_id % 5) * 20000 + sum(CASE (user_id + blk) % 2 WHEN 0 THEN st ELSE 0 END) OVER w AS la,
         2400000 + (user_id % 3) * 30000 + sum(CASE (user_id + blk) % 2 WHEN 1 THEN st ELSE 0 END) OVER w AS lo
  FROM trace
  WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
) p
"""

RIDE_DISPLACEMENTS = """
SELECT user_id, blk, min(t) AS t_start, max(t) AS t_end,
       CASE user_id % 5 WHEN 0 THEN 'BUS' WHEN 1 THEN 'BIKE' WHEN 2 THEN 'PRIV_CAR_DRIVER' WHEN 3 THEN 'WALKING' ELSE 'OTHER' END AS mode_1
FROM trace
WHERE blk % 3 <> 1
GROUP BY user_id, blk
"""

#: The tables of each fixture in the order in which they build on each other.
RECIPES = {
    "events": {"trace": TRACE, "points": POINTS, "displacements": DISPLACEMENTS, "individuals": INDIVIDUALS},
    "rides": {"trace": RIDE_TRACE, "points": RIDE_POINTS, "displacements": RIDE_DISPLACEMENTS, "individuals": INDIVIDUALS},
}


def duckdb_ctes(source: str = "events") -> dict[str, str]:
    return {name: sql.format(**DUCKDB) for name, sql in RECIPES[source].items()}


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


#: The table of each source and the columns that it reads, the user's first.
SOURCES = {"events": ("events", ("user_id", "event_id", "value", "ts")), "rides": ("lineitem", ("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"))}


def tasks(spark: SparkSession, sf_dir: str, source: str = "events") -> int:
    """How many tasks the points are dealt out to; Parquet knows its rows."""
    return tasks_for(spark, _read(spark, sf_dir, SOURCES[source][0]).count())


def _trace(spark: SparkSession, sf_dir: str, source: str, tasks: int | None) -> DataFrame:
    """The recipe over the columns that it reads, dealt out by user."""
    name, columns = SOURCES[source]
    sql = RECIPES[source]["trace"].format(**SPARK).replace(f"FROM {name}", "FROM {rows}")
    return spark.sql(sql, rows=dealt(_read(spark, sf_dir, name, *columns), tasks, columns[0]))


def gps_points(spark: SparkSession, sf_dir: str, source: str = "events", tasks: int | None = None) -> DataFrame:
    """user_id, event_id, t (microseconds), lat, lon."""
    return spark.sql(RECIPES[source]["points"].format(**SPARK).replace("FROM trace", "FROM {trace}"), trace=_trace(spark, sf_dir, source, tasks))


def displacements(spark: SparkSession, sf_dir: str, source: str = "events", tasks: int | None = None) -> DataFrame:
    """user_id, blk, t_start, t_end, mode_1."""
    return spark.sql(RECIPES[source]["displacements"].format(**SPARK).replace("FROM trace", "FROM {trace}"), trace=_trace(spark, sf_dir, source, tasks))


def individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, sex, age, diploma."""
    return spark.sql(INDIVIDUALS.format(**SPARK).replace("FROM customer", "FROM {customer}"), customer=_read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"))
