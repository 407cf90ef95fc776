"""Places of rows in an order of the whole table, without a task that orders it: ranges of rows and running sums of their sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelscan.sources.scratch import stored


def numbered(rows: DataFrame, by: str, order: list[str | Column]) -> DataFrame:
    """rows plus _at, their place from 0 among the rows of the same `by`, and _size, how many those are. Nulls come first.

    Rows are sorted by ranges of (by, order), and each task numbers its own; the tasks' counts, a row for each task that
    holds rows of a group, are summed up and move them to their place. Rows that agree in everything have any order.
    """
    keys = [F.col(by).asc_nulls_first(), *[F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in order]]
    own = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_own", own).withColumn("_task", F.shiftright("_own", 33))
    placed = stored(placed, "placed")
    runs = placed.groupBy(by, "_task").agg(F.min("_own").alias("_first"), F.count(F.lit(1)).alias("_n"))
    tasks = W.partitionBy(by)
    before = F.coalesce(F.sum("_n").over(tasks.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col(by).alias("_group"), F.col("_task").alias("_of"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(tasks).alias("_size"))
    out = placed.join(stored(runs, "runs"), F.col(by).eqNullSafe(F.col("_group")) & (F.col("_task") == F.col("_of")))
    return out.withColumn("_at", F.col("_own") + F.col("_shift")).drop("_own", "_task", "_group", "_of", "_shift")


def running(rows: DataFrame, order: str, amount: str) -> DataFrame:
    """rows plus _before, the sum of an amount over the rows before each one in the order of distinct, non-null values.

    As numbered(): ranges of rows, sums within each task's range, and running sums of the tasks' totals.
    """
    placed = rows.repartitionByRange(F.col(order)).withColumn("_task", F.spark_partition_id())
    placed = stored(placed, "placed")
    totals = placed.groupBy("_task").agg(F.sum(amount).alias("_total"))  # a row for each task
    start = F.coalesce(F.sum("_total").over(W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum(amount).over(W.partitionBy("_task").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(totals.select("_task", start.alias("_start"))), "_task").withColumn("_before", F.col("_start") + inside).drop("_task", "_start")
