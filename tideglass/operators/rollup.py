"""Day partials of the activity summary, and summaries of any range merged from them.

Events of a day are reduced to counts per application and to bitmaps of the windows seen.
Both are mergeable: partials of batches, or of days, add up by summing counts and OR-ing
bitmaps, so the number of distinct windows of a range is exact. A range is its whole days'
partials merged, plus the log's rows of the days that it only cuts: at most two.

A bitmap covers 32,768 consecutive window ids in 4 KiB, so a day's bitmaps are bounded by the
dimension's size, not by the day's events.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, time, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.functions.times import as_utc
from tideglass.operators.summary import SummaryQuery, in_range, kind_counts, summarise
from tideglass.schemas import UNKNOWN_APP

_COUNTS = ("total_events", "key_events", "button_events", "wheel_events")
_LAST_MOMENT = time(23, 59, 59, 999_999)


@dataclass(frozen=True)
class DayPartials:
    """`apps`: (occurred_date, app_name, counts); `seen`: (occurred_date, bucket, windows), where
    `windows` is the bitmap of the window ids of a bucket. Neither repeats a key.
    """

    apps: DataFrame
    seen: DataFrame

    def merged(self, other: DayPartials) -> DayPartials:
        """Partials of both: of two batches, or of other days."""
        apps = self.apps.unionByName(other.apps).groupBy("occurred_date", "app_name")
        seen = self.seen.unionByName(other.seen).groupBy("occurred_date", "bucket")
        return DayPartials(
            apps.agg(*[F.sum(name).alias(name) for name in _COUNTS]),
            seen.agg(F.bitmap_or_agg("windows").alias("windows")),
        )


def _dated(events: DataFrame) -> DataFrame:
    if "occurred_date" in events.columns:
        return events
    return events.withColumn("occurred_date", F.to_date("occurred_at"))


def day_partials(events: DataFrame, windows: DataFrame) -> DayPartials:
    """Partials of all days of `events`, which may be the whole log or one batch.

    The log is reduced to a row per day and window before it meets the dimension.
    """
    per_window = _dated(events).groupBy("occurred_date", "window_id").agg(*kind_counts())
    named = per_window.join(windows.select("window_id", "app_name"), "window_id", "left")
    apps = named.groupBy("occurred_date", F.coalesce("app_name", F.lit(UNKNOWN_APP)).alias("app_name"))
    known = per_window.where(F.col("window_id").isNotNull())
    seen = known.groupBy("occurred_date", F.bitmap_bucket_number("window_id").alias("bucket"))
    return DayPartials(
        apps.agg(*[F.sum(name).alias(name) for name in _COUNTS]),
        seen.agg(F.bitmap_construct_agg(F.bitmap_bit_position("window_id")).alias("windows")),
    )


def split_range(query: SummaryQuery) -> tuple[date | None, date | None, list[date]]:
    """First and last whole day of a range, None where a side is open, and the days it cuts."""
    first = last = None
    cut = []
    if query.start_at is not None:
        start = as_utc(query.start_at)
        first = start.date()
        if start.time() != time():
            cut.append(first)
            first += timedelta(days=1)
    if query.end_at is not None:
        end = as_utc(query.end_at)
        last = end.date()
        if end.time() != _LAST_MOMENT:
            cut.append(last)
            last -= timedelta(days=1)
    return first, last, sorted(set(cut))


def summary_from_days(
    partials: DayPartials, events: DataFrame, windows: DataFrame, query: SummaryQuery = SummaryQuery()
) -> DataFrame:
    """The activity summary of a range: as `activity_summary`, with rows of the log read only for
    the days that the range cuts.
    """
    first, last, cut = split_range(query)
    apps, seen = partials.apps, partials.seen
    for bound, holds in ((first, lambda d: F.col("occurred_date") >= d), (last, lambda d: F.col("occurred_date") <= d)):
        if bound is not None:
            apps, seen = apps.where(holds(F.lit(bound))), seen.where(holds(F.lit(bound)))
    if cut:
        rows = in_range(_dated(events), query.start_at, query.end_at)
        edges = day_partials(rows.where(F.col("occurred_date").isin(cut)), windows)
        apps, seen = apps.unionByName(edges.apps), seen.unionByName(edges.seen)
    per_app = apps.groupBy("app_name").agg(*[F.sum(name).alias(name) for name in _COUNTS])
    distinct = seen.groupBy("bucket").agg(F.bitmap_count(F.bitmap_or_agg("windows")).alias("held"))
    count = distinct.agg(F.coalesce(F.sum("held"), F.lit(0)).alias("held"))
    summary = summarise(per_app.withColumn("active_windows", F.lit(0).cast("bigint")))
    return summary.withColumn("active_windows", count.scalar())
