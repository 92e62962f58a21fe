"""Activity summary over the stored log."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.functions.times import as_utc
from tideglass.schemas import (
    BUTTON_KINDS,
    KEY_KINDS,
    TOP_APPS_LIMIT,
    UNKNOWN_APP,
    WHEEL_KIND,
)

TOTALS = ("total_events", "key_events", "button_events", "wheel_events", "active_windows")


@dataclass(frozen=True)
class SummaryQuery:
    """Both bounds are inclusive; None leaves a side open."""

    start_at: datetime | str | None = None
    end_at: datetime | str | None = None


def in_range(
    events: DataFrame, start_at: datetime | str | None, end_at: datetime | str | None
) -> DataFrame:
    """Events between two inclusive bounds; date partitions outside are not read."""
    dated = "occurred_date" in events.columns
    if start_at is not None:
        start = as_utc(start_at)
        events = events.where(F.col("occurred_at") >= F.lit(start))
        if dated:
            events = events.where(F.col("occurred_date") >= F.lit(start.date()))
    if end_at is not None:
        end = as_utc(end_at)
        events = events.where(F.col("occurred_at") <= F.lit(end))
        if dated:
            events = events.where(F.col("occurred_date") <= F.lit(end.date()))
    return events


def _kinds(kinds: tuple[str, ...]) -> str:
    return ", ".join(f"'{kind}'" for kind in kinds)


def kind_counts() -> list[Column]:
    """All events, and those of each group of kinds."""
    return [
        F.expr("count(*) AS total_events"),
        F.expr(f"count_if(event_kind IN ({_kinds(KEY_KINDS)})) AS key_events"),
        F.expr(f"count_if(event_kind IN ({_kinds(BUTTON_KINDS)})) AS button_events"),
        F.expr(f"count_if(event_kind = '{WHEEL_KIND}') AS wheel_events"),
    ]


def activity_summary(
    events: DataFrame, windows: DataFrame, query: SummaryQuery = SummaryQuery()
) -> DataFrame:
    """One row: totals, exact number of active windows, top applications with share.

    The log is reduced to one row per window before it meets the dimension, so the
    join and all that follows work on dimension-sized data.
    """
    per_window = (
        in_range(events, query.start_at, query.end_at).groupBy("window_id").agg(*kind_counts())
    )
    named = per_window.join(windows.select("window_id", "app_name"), "window_id", "left")
    return summarise(
        named.selectExpr(
            f"coalesce(app_name, '{UNKNOWN_APP}') AS app_name",
            "CAST(window_id IS NOT NULL AS BIGINT) AS active_windows",
            "total_events",
            "key_events",
            "button_events",
            "wheel_events",
        )
    )


def summarise(per_window: DataFrame) -> DataFrame:
    """The summary from counts per window with `app_name` and `active_windows` 0 or 1.

    A rollup by application gives the grand total and the counts per application from
    the same pass, and only the grand total and the top rows reach the last step.
    """
    kept = (
        per_window.rollup("app_name")
        .agg(
            F.expr("grouping(app_name) = 1 AS is_total"),
            *[F.expr(f"sum({name}) AS {name}") for name in TOTALS],
        )
        .orderBy("is_total", "total_events", "app_name", ascending=[False, False, True])
        .limit(TOP_APPS_LIMIT + 1)
    )
    one = kept.agg(
        *[F.expr(f"coalesce(max({name}) FILTER (WHERE is_total), 0) AS {name}") for name in TOTALS],
        F.expr(
            "sort_array(collect_list(struct(-total_events AS rank_key, app_name, "
            "total_events AS event_count)) FILTER (WHERE NOT is_total)) AS ranked"
        ),
    )
    # The share is of all events in range, not of the listed ones.
    return one.selectExpr(
        *TOTALS,
        """transform(ranked, app -> struct(
            app.app_name AS app_name,
            app.event_count AS event_count,
            IF(total_events = 0, 0D,
               CAST(app.event_count AS DOUBLE) / CAST(total_events AS DOUBLE) * 100D) AS share
        )) AS top_apps""",
    )


def with_pointer_events(summary: DataFrame) -> DataFrame:
    """Add pointer events: buttons and wheel together."""
    return summary.withColumn("pointer_events", F.col("button_events") + F.col("wheel_events"))


def summary_totals(
    events: DataFrame, windows: DataFrame, query: SummaryQuery = SummaryQuery()
) -> DataFrame:
    return with_pointer_events(activity_summary(events, windows, query).drop("top_apps"))


def top_apps(
    events: DataFrame, windows: DataFrame, query: SummaryQuery = SummaryQuery()
) -> DataFrame:
    """Applications by number of events, ties by name; `pos` is the rank from 1."""
    return (
        activity_summary(events, windows, query)
        .select(F.posexplode("top_apps"))
        .select((F.col("pos") + 1).alias("pos"), "col.*")
    )


def last_event_at(events: DataFrame) -> DataFrame:
    """The newest event time; NULL for an empty log."""
    return events.agg(F.max("occurred_at").alias("last_event_at"))
