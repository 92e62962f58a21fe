"""Consecutive row numbers over a whole DataFrame without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.session import materialise

# monotonically_increasing_id() keeps the task in the upper bits and counts the
# rows of a task from zero in the lower 33.
ROW_BITS = 33
ROW_MASK = (1 << ROW_BITS) - 1


def number_rows(
    df: DataFrame, order_by: Sequence[Column], out: str, start: int = 1
) -> DataFrame:
    """Add `out`: start, start+1, ... in the order of `order_by`, which must be total.

    The sort is a range-partitioned distributed sort. Its result is written once with
    each row's place in its task, so that the task sizes and the numbers come from the
    same rows; only one small row per sort task is brought together for the offsets.
    """
    placed = materialise(
        df.orderBy(*order_by).withColumn("_slot", F.monotonically_increasing_id())
    ).withColumn("_task", F.shiftright("_slot", ROW_BITS))
    sizes = placed.groupBy("_task").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_task", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )
    # One row per sort task: bounded by spark.sql.shuffle.partitions.
    return (
        placed.join(F.broadcast(offsets), "_task")
        .withColumn(
            out, F.lit(start) + F.col("_before") + F.col("_slot").bitwiseAND(F.lit(ROW_MASK))
        )
        .drop("_task", "_slot", "_before")
    )
