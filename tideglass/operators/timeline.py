"""Event and window lists: filters, search, sorts, pages, lookups."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideglass.functions.text import contains_text, normalise_search
from tideglass.operators.lookup import content_bytes, lookup_join
from tideglass.operators.numbering import ROW_MASK
from tideglass.operators.summary import in_range
from tideglass.schemas import (
    DEFAULT_PAGE,
    DEFAULT_PAGE_SIZE,
    EVENT,
    EVENT_KINDS,
    MAX_PAGE_SIZE,
    WINDOW,
)

EVENT_SORTS = {
    "occurred_at": "occurred_at",
    "event_id": "event_id",
    "kind": "event_kind",
    "value": "event_value",
    "app_name": "app_name",
}
WINDOW_SORTS = ("last_seen_at", "first_seen_at", "window_id", "app_name", "event_count")

# A page that ends below TOP_K_ROWS is found by a top-k; beyond it quantiles of the sort key
# narrow the list down to RANGE_ROWS around the page, and only those are sorted. The last step
# of a top-k is one task: it meets at most DIRECT_ROWS rows, and from a longer list the
# candidates are thinned out first.
TOP_K_ROWS = 5_000
RANGE_ROWS = 5_000
QUANTILE_ACCURACY = 10_000
# Behind every digit: keys that are NULL come last in both directions.
NULL_DIGIT = 1 << 62
DIGIT_BYTES = 7
DIRECT_ROWS = 10_000_000
LAST_STEP_ROWS = 1_000_000
MAX_GROUPS = 1000


@dataclass(frozen=True)
class EventQuery:
    """All fields are optional; set filters are joined by AND, time bounds are inclusive."""

    page: int | None = None
    size: int | None = None
    cursor: int | None = None
    start_at: datetime | str | None = None
    end_at: datetime | str | None = None
    kind: str | None = None
    window_id: int | None = None
    search: str | None = None
    app_name: str | None = None
    context_hash: str | None = None
    sort_by: str | None = None
    sort_direction: str | None = None


@dataclass(frozen=True)
class WindowQuery:
    page: int | None = None
    size: int | None = None
    cursor: int | None = None
    search: str | None = None
    app_name: str | None = None
    context_hash: str | None = None
    sort_by: str | None = None
    sort_direction: str | None = None


@dataclass(frozen=True)
class Page:
    """`rows` carry their zero-based position in the whole sorted list as `pos`."""

    page: int
    size: int
    total: int
    pages: int
    rows: DataFrame


def resolve_paging(
    page: int | None, size: int | None, cursor: int | None
) -> tuple[int, int, int]:
    """(page, size, offset): size clamped to 1..1000; a cursor is an offset and wins."""
    size = min(max(DEFAULT_PAGE_SIZE if size is None else size, 1), MAX_PAGE_SIZE)
    if cursor is not None:
        offset = max(cursor, 0)
        return offset // size + 1, size, offset
    page = max(DEFAULT_PAGE if page is None else page, 1)
    return page, size, (page - 1) * size


def page_count(total: int, size: int) -> int:
    return -(-total // size)


def sort_keys(column: str, tie: str, direction: str | None) -> list[Column]:
    """Sort and tie-breaker in one direction, descending by default, NULLs always last."""
    direction = direction or "desc"
    if direction not in ("asc", "desc"):
        raise ValueError(f"unknown sort direction: {direction}")
    names = [column] if column == tie else [column, tie]
    if direction == "asc":
        return [F.col(name).asc_nulls_last() for name in names]
    return [F.col(name).desc_nulls_last() for name in names]


def _one_of(value: str | None, allowed, default: str, what: str) -> str:
    value = value or default
    if value not in allowed:
        raise ValueError(f"unknown {what}: {value}")
    return value


def window_predicates(query: EventQuery | WindowQuery) -> list[Column]:
    """Filters on the dimension; an event without a window passes none of them."""
    tests = []
    search = normalise_search(query.search)
    if search is not None:
        tests.append(contains_text(F.col("app_name"), search))
    if query.app_name is not None:
        tests.append(F.col("app_name") == query.app_name)
    if query.context_hash is not None:
        tests.append(F.col("context_hash") == query.context_hash)
    return tests


def _where_all(df: DataFrame, tests: list[Column]) -> DataFrame:
    for test in tests:
        df = df.where(test)
    return df


def filter_events(events: DataFrame, query: EventQuery) -> DataFrame:
    """The filters that need the log only."""
    events = in_range(events, query.start_at, query.end_at)
    if query.kind is not None:
        events = events.where(F.col("event_kind") == _one_of(query.kind, EVENT_KINDS, "", "kind"))
    if query.window_id is not None:
        events = events.where(F.col("window_id") == query.window_id)
    return events


def matching_events(
    events: DataFrame, windows: DataFrame, query: EventQuery, with_app: bool = False
) -> DataFrame:
    """Events that pass every filter; meets the dimension only if the query needs it.

    Window filters run on the dimension, then select events by window id.
    """
    events = filter_events(events, query)
    tests = window_predicates(query)
    if not tests and not with_app:
        return events
    columns = ["window_id", "event_count"] + (["app_name"] if with_app else [])
    return lookup_join(
        events,
        _where_all(windows, tests).select(*columns),
        ["window_id"],
        weight="event_count",
        spread="event_id",
        how="inner" if tests else "left",
    )


def count_events(events: DataFrame, windows: DataFrame, query: EventQuery) -> DataFrame:
    """Total of the filtered list, as one row."""
    return matching_events(events, windows, query).agg(F.count(F.lit(1)).alias("total"))


def joined_records(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Pair each of a page's events with its window; `window` is NULL as a whole without one.

    `rows` must be a page: it is what bounds the dimension rows that are broadcast.
    """
    side = windows.select(
        F.col("window_id").alias("_window_id"),
        F.struct(*[f.name for f in WINDOW.fields]).alias("window"),
    )
    return rows.join(
        F.broadcast(side), F.col("window_id") == F.col("_window_id"), "left"
    ).drop("_window_id")


def all_records(events: DataFrame, windows: DataFrame) -> DataFrame:
    """The whole log, each event paired with its window or NULL."""
    side = windows.select(
        "window_id",
        F.col("event_count").alias("_weight"),
        F.struct(*[f.name for f in WINDOW.fields]).alias("window"),
    )
    found = lookup_join(
        events,
        side,
        ["window_id"],
        weight="_weight",
        spread="event_id",
        dim_bytes=content_bytes(windows),
    )
    return found.select(F.struct(*[f.name for f in EVENT.fields]).alias("event"), "window")


def _among(column: str, values) -> Column:
    """`column IN (...)` for a page's integers or dates, as one expression."""
    listed = [f"DATE '{v}'" if isinstance(v, date) else str(int(v)) for v in values]
    return F.expr(f"{column} IN ({', '.join(listed)})") if listed else F.lit(False)


def _page_days(
    per_day: list[tuple], descending: bool, offset: int, size: int
) -> tuple[list, int]:
    """Days that hold rows [offset, offset + size), and the offset within them."""
    days, before, start = [], 0, None
    for day, rows in sorted(per_day, reverse=descending):
        if before + rows > offset and before < offset + size:
            days.append(day)
            start = offset - before if start is None else start
        before += rows
    return days, start or 0


def _first_of_each_task(df: DataFrame, order: list[Column], rows: int) -> DataFrame:
    """Each task's first rows, by a local sort; no shuffle."""
    return (
        df.sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
        .where(F.col("_slot").bitwiseAND(F.lit(ROW_MASK)) < rows)
        .drop("_slot")
    )


def _digit(keys: DataFrame, name: str, level: int, descending: bool) -> Column:
    """A whole number that orders rows as `name` does, as far as it tells them apart.

    Of a text it is bytes 7 * level to 7 * level + 6, so it orders rows whose earlier bytes agree.
    """
    column, kind = F.col(name), keys.schema[name].dataType
    if isinstance(kind, T.StringType):
        digits = F.substring(F.hex(column), 2 * DIGIT_BYTES * level + 1, 2 * DIGIT_BYTES)
        number = F.conv(F.rpad(digits, 2 * DIGIT_BYTES, "0"), 16, 10).cast("bigint")
    elif isinstance(kind, T.TimestampType):
        number = F.unix_micros(column)
    else:
        number = column.cast("bigint")
    return F.coalesce(-number if descending else number, F.lit(NULL_DIGIT))


def _quantile_range(rows: DataFrame, digit: Column, place: int, size: int, held: int) -> tuple[int, int, int, int]:
    """Least and greatest digit of a range that holds rows [place, place + size) of `held`, with
    the exact numbers of rows below and within it. A sketch proposes, the counts confirm.
    """
    margin = 2 / QUANTILE_ACCURACY
    while True:
        shares = [max(place / held - margin, 0.0), min((place + size) / held + margin, 1.0)]
        low, high = rows.agg(F.percentile_approx(digit, shares, QUANTILE_ACCURACY)).first()[0]
        # The sketch keeps doubles, which round whole numbers beyond 2**53.
        low, high = low - (abs(low) >> 52), high + (abs(high) >> 52)
        inside = (digit >= low) & (digit <= high)
        below, within, least, most = rows.agg(
            F.count_if(digit < low), F.count_if(inside), F.min(F.when(inside, digit)), F.max(F.when(inside, digit))
        ).first()
        if below <= place and place + size <= below + within:
            return least, most, below, within
        margin = min(4 * margin, 1.0)


def _narrowed(
    rows: DataFrame, names: list[str], level: int, descending: bool, place: int, size: int, held: int
) -> list[tuple[DataFrame, int, int]]:
    """(rows, place, size): parts that hold rows [place, place + size) of `held` in the order of
    `names`, each of at most RANGE_ROWS rows or of rows that the names cannot tell apart.
    """
    if held <= RANGE_ROWS or not names:
        return [(rows, place, size)]
    digit = _digit(rows, names[0], level, descending)
    low, high, below, within = _quantile_range(rows, digit, place, size, held)
    here = rows.where((digit >= low) & (digit <= high))
    if low == high:
        text = isinstance(rows.schema[names[0]].dataType, T.StringType) and low != NULL_DIGIT
        if text:
            least, most = here.agg(F.min(names[0]), F.max(names[0])).first()
            reach = DIGIT_BYTES * (level + 1)
            if least != most:
                if max(len(least.encode()), len(most.encode())) <= reach:
                    return [(here, place - below, size)]  # they differ in NUL bytes at their end
                return _narrowed(here, names, level + 1, descending, place - below, size, within)
        return _narrowed(here, names[1:], 0, descending, place - below, size, within)
    if within < held:
        return _narrowed(here, names, level, descending, place - below, size, within)
    # Single digits hold most rows and the page lies across: each part has its share of it.
    cuts = [digit == low, (digit > low) & (digit < high), digit == high]
    counts = rows.agg(*[F.count_if(cut) for cut in cuts]).first()
    parts = []
    for cut, count in zip(cuts, counts):
        begin, end = max(place, 0), min(place + size, count)
        if begin < end:
            parts += _narrowed(rows.where(cut), names, level, descending, begin, end - begin, count)
        place -= count
    return parts


def _page_of(
    keys: DataFrame, names: list[str], order: list[Column], descending: bool, offset: int, size: int, total: int
) -> DataFrame:
    """Rows [offset, offset + size) of `total` rows in the order of `names`, the last of which
    makes it total.
    """
    last = min(offset + size, total)
    if last <= TOP_K_ROWS:
        if total > DIRECT_ROWS:
            # The page is among the first rows of each task, and again of each group.
            groups = min(max(LAST_STEP_ROWS // max(last, 1), 1), MAX_GROUPS)
            first = _first_of_each_task(keys, order, last).repartition(groups, names[-1])
            keys = _first_of_each_task(first, order, last)
        return keys.orderBy(*order).offset(offset).limit(size)
    if offset >= last:
        return keys.limit(0)
    parts = _narrowed(keys, names, 0, descending, offset, last - offset, total)
    pages = [rows.orderBy(*order).offset(place).limit(many) for rows, place, many in parts]
    return reduce(DataFrame.union, pages)


def _with_pos(rows: DataFrame, order: list[Column], offset: int) -> DataFrame:
    """Number a page of at most MAX_PAGE_SIZE rows."""
    place = F.row_number().over(Window.orderBy(*order))
    return rows.withColumn("pos", (place + F.lit(offset - 1)).cast("bigint"))


def list_events(events: DataFrame, windows: DataFrame, query: EventQuery) -> Page:
    """A page of events with their windows.

    1. Count the matches, per day where the log is partitioned by day: the counts give
       the total, and for a sort by time the days that hold the page.
    2. Find the page on the sort key and the event id alone: the first rows by a top-k, a
       deep page within the range of keys that quantiles and exact counts prove to hold it.
    3. Fetch the page's full rows, at most MAX_PAGE_SIZE, by id and day, and only their
       windows.
    """
    page, size, offset = resolve_paging(query.page, query.size, query.cursor)
    sort_by = _one_of(query.sort_by, EVENT_SORTS, "occurred_at", "sort key")
    column = EVENT_SORTS[sort_by]
    order = sort_keys(column, "event_id", query.sort_direction)
    descending = (query.sort_direction or "desc") == "desc"

    matches = matching_events(events, windows, query)
    dated = "occurred_date" in events.columns
    if dated:
        per_day = [tuple(r) for r in matches.groupBy("occurred_date").count().collect()]
        total = sum(rows for _, rows in per_day)
    else:
        per_day, total = [], matches.count()

    place, held = offset, total
    if sort_by == "app_name":
        matches = matching_events(events, windows, query, with_app=True)
    elif sort_by == "occurred_at" and dated:
        days, place = _page_days(per_day, descending, offset, size)
        matches = matches.where(_among("occurred_date", days))
        held = sum(rows for day, rows in per_day if day in days)

    found = []
    if offset < total:
        days_column = ["occurred_date"] if dated else []
        wanted = list(dict.fromkeys(["event_id", column, "window_id", *days_column]))
        keys = matches.select(*wanted)
        found = (
            _page_of(keys, list(dict.fromkeys([column, "event_id"])), order, descending, place, size, held)
            .select("event_id", "window_id", *days_column)
            .collect()
        )

    rows = events.where(_among("event_id", [r["event_id"] for r in found]))
    if dated:
        rows = rows.where(_among("occurred_date", {r["occurred_date"] for r in found}))
    window_ids = {r["window_id"] for r in found} - {None}
    rows = joined_records(
        rows.select(*[f.name for f in EVENT.fields]),
        windows.where(_among("window_id", window_ids)),
    )
    if sort_by == "app_name":
        rows = rows.withColumn("app_name", F.col("window.app_name"))
    rows = _with_pos(rows, order, offset).select(
        "pos", F.struct(*[f.name for f in EVENT.fields]).alias("event"), "window"
    )
    return Page(page, size, total, page_count(total, size), rows.orderBy("pos"))


def list_windows(windows: DataFrame, query: WindowQuery) -> Page:
    """A page of the dimension."""
    page, size, offset = resolve_paging(query.page, query.size, query.cursor)
    column = _one_of(query.sort_by, WINDOW_SORTS, "last_seen_at", "sort key")
    order = sort_keys(column, "window_id", query.sort_direction)

    matches = _where_all(windows, window_predicates(query)).select(
        *[f.name for f in WINDOW.fields]
    )
    total = matches.count()
    names = list(dict.fromkeys([column, "window_id"]))
    descending = (query.sort_direction or "desc") == "desc"
    rows = _with_pos(_page_of(matches, names, order, descending, offset, size, total), order, offset)
    rows = rows.select("pos", *[f.name for f in WINDOW.fields])
    return Page(page, size, total, page_count(total, size), rows.orderBy("pos"))


def page_info(page: Page) -> DataFrame:
    """A page's numbers as one row."""
    spark = page.rows.sparkSession
    return spark.range(1).select(
        F.lit(page.page).cast("bigint").alias("page"),
        F.lit(page.size).cast("bigint").alias("size"),
        F.lit(page.total).cast("bigint").alias("total"),
        F.lit(page.pages).cast("bigint").alias("pages"),
    )


def event_by_id(events: DataFrame, event_id: int) -> DataFrame:
    return events.where(F.col("event_id") == event_id).select(*[f.name for f in EVENT.fields])


def window_by_id(windows: DataFrame, window_id: int) -> DataFrame:
    return windows.where(F.col("window_id") == window_id).select(*[f.name for f in WINDOW.fields])


def window_by_hash(windows: DataFrame, context_hash: str) -> DataFrame:
    return windows.where(F.col("context_hash") == context_hash).select(
        *[f.name for f in WINDOW.fields]
    )
