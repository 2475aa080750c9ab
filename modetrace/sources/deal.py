"""How many tasks a table is dealt out to.

Spark's own count of shuffle partitions is fixed, and small ones are put together by their
compressed size, which for points is a few bytes a row: a task's sorts then grow with
the table. Here the count follows the rows, and a stated count is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a task, on average.
ROWS_A_TASK = 250_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """At least a task for each core."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))


def parts_for(rows: Column) -> Column:
    """Into how many parts a group of so many rows goes."""
    return F.ceil(rows / ROWS_A_TASK)


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """By hash of the keys; as Spark does it where ``tasks`` is unknown."""
    return df if tasks is None else df.repartition(tasks, *keys)
