"""Constraint report over a stored log and dimension."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.schemas import (
    EVENT_KINDS,
    REQUIRED_EVENT_COLUMNS,
    REQUIRED_WINDOW_COLUMNS,
)


def _row_checks(df: DataFrame, table: str, required: tuple[str, ...], kinds: bool) -> DataFrame:
    """Checks that look at one row at a time, all in a single pass."""
    checks = [(f"not_null:{name}", F.col(name).isNull()) for name in required]
    if kinds:
        checks.append(
            ("known_kind", F.col("event_kind").isNotNull() & ~F.col("event_kind").isin(*EVENT_KINDS))
        )
    counted = df.agg(
        F.array(
            *[
                F.struct(F.lit(name).alias("rule"), F.count_if(broken).alias("violations"))
                for name, broken in checks
            ]
        ).alias("checks")
    )
    return counted.select(F.lit(table).alias("table_name"), F.inline("checks"))


def _key_check(df: DataFrame, table: str, key: str) -> DataFrame:
    """Number of key values that occur more than once."""
    repeated = (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    return repeated.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit(f"unique:{key}").alias("rule"), "violations"
    )


def _reference_check(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Events that name a window the dimension does not have, counted per window first."""
    per_window = (
        events.where(F.col("window_id").isNotNull())
        .groupBy("window_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    dangling = per_window.join(windows.select("window_id"), "window_id", "left_anti")
    return dangling.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(
        F.lit("input_events").alias("table_name"),
        F.lit("references:window_id").alias("rule"),
        "violations",
    )


def constraint_report(events: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per rule: (table_name, rule, violations)."""
    parts = [
        _row_checks(events, "input_events", REQUIRED_EVENT_COLUMNS, kinds=True),
        _row_checks(windows, "observed_windows", REQUIRED_WINDOW_COLUMNS, kinds=False),
        _key_check(events, "input_events", "event_id"),
        _key_check(windows, "observed_windows", "window_id"),
        _key_check(windows, "observed_windows", "context_hash"),
        _reference_check(events, windows),
    ]
    return reduce(DataFrame.unionByName, parts)
