"""Every operator as a query over the given tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideglass.functions.hashing import context_hash
from tideglass.functions.rawjson import is_valid_json, repeated_members
from tideglass.operators import dimension as dim
from tideglass.operators import rollup, summary, timeline, views
from tideglass.operators.numbering import number_rows
from tideglass.operators.quality import constraint_report
from tideglass.operators.summary import SummaryQuery
from tideglass.operators.timeline import EventQuery, Page, WindowQuery
from tideglass.plans.fixtures import arrivals, captures, given_events, stored
from tideglass.schemas import IDENTITY, WINDOW, WINDOW_STATE
from tideglass.session import materialise, prepare, scratch_folder
from tideglass.sources.capture import normalise_capture
from tideglass.sources.lines import (
    decode_events,
    event_lines,
    quarantined,
    read_lines,
    to_wire,
    valid_events,
    wire_json,
)
from tideglass.store import Snapshot, TimelineStore
from tideglass.streaming.pipeline import stream_lines, stream_payloads
from tideglass.streaming.running import running_result, stream_dimension, stream_summary

Query = Callable[[SparkSession, str], DataFrame]

START = "2024-01-05T00:00:00Z"
END = "2024-01-12T12:00:00Z"
# Bounds within days, whose rest is not counted.
CUT_START, SAME_DAY, CUT_END = "2024-01-05T07:30:00Z", "2024-01-05T19:45:10Z", "2024-01-12T23:59:59Z"
EMPTY_RANGE = SummaryQuery("2024-01-12T00:00:00Z", "2024-01-05T00:00:00Z")
EVENT_ID = 42
WINDOW_ID = 5
USER = 7
PREFIX = "@event "
FEED_FILES = 4
SORT_SIZE = 1000
EVENT_SORT_CURSOR = 8500
WINDOW_SORT_CURSOR = 10

EVENT_COLUMNS = (
    "event_id", "occurred_at", "event_kind", "event_value", "delta_x", "delta_y",
    "window_id", "raw_event", "raw_window", "collector_name", "collector_version",
)


def plain(df: DataFrame) -> DataFrame:
    """Instants as UTC wall clock and process ids as bigint, the types of the given tables."""
    casts: dict[str, Column] = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.TimestampType):
            casts[field.name] = F.col(field.name).cast("timestamp_ntz")
        elif isinstance(field.dataType, T.DecimalType):
            casts[field.name] = F.col(field.name).cast("bigint")
    return df.withColumns(casts) if casts else df


def _event_page(page: Page) -> DataFrame:
    return plain(
        page.rows.select(
            "pos",
            *[F.col(f"event.{name}").alias(name) for name in EVENT_COLUMNS],
            F.col("window").isNotNull().alias("has_window"),
            F.col("window.app_name").alias("app_name"),
            F.col("window.title").alias("title"),
        )
    )


def _window_page(page: Page) -> DataFrame:
    return plain(page.rows)


def _matching(query: EventQuery) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = stored(spark, sf_dir)
        return plain(timeline.matching_events(s.log, s.windows, query).select(*EVENT_COLUMNS))

    return run


def _listed(query: EventQuery) -> Query:
    return lambda spark, sf_dir: _event_page(stored(spark, sf_dir).list_events(query))


def _listed_windows(query: WindowQuery) -> Query:
    return lambda spark, sf_dir: _window_page(stored(spark, sf_dir).list_windows(query))


def _hash_of_user(spark: SparkSession, sf_dir: str) -> str:
    row = stored(spark, sf_dir).windows.where(F.col("process_id") == USER).first()
    return row["context_hash"]


# Hash and dimension.


def q_context_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = arrivals(given_events(spark, sf_dir)).where("window IS NOT NULL")
    distinct = windows.select(*[f"window.{name}" for name in IDENTITY]).distinct()
    hashed = distinct.withColumn("context_hash", context_hash(*[F.col(n) for n in IDENTITY]))
    return plain(hashed)


def q_window_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = dim.build_dimension(arrivals(given_events(spark, sf_dir)))
    return plain(built.select(*WINDOW.names))


def q_event_window_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).events.select("event_id", "window_id")


def q_dimension_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches in order of arrival, folded one after the other."""
    payloads = arrivals(given_events(spark, sf_dir))
    first, last = payloads.agg(F.min("event_id"), F.max("event_id")).first()
    current = prepare(spark).createDataFrame([], WINDOW_STATE)
    step = (last - first) // 3 + 1
    for low in range(first, last + 1, step):
        batch = payloads.where((F.col("event_id") >= low) & (F.col("event_id") < low + step))
        partials = materialise(dim.identity_partials(batch))
        highest = current.agg(F.max("window_id")).first()[0] or 0
        current = materialise(dim.advance_dimension(current, partials, highest)[0])
    return plain(current.select(*WINDOW.names))


def _stream_folder(spark: SparkSession) -> str:
    return f"{scratch_folder(prepare(spark))}/streams/{uuid.uuid4().hex}"


def _arrival_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = given_events(spark, sf_dir).schema
    # As a pattern, the path may be one file or a folder of files.
    return arrivals(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]"))


def q_dimension_streaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _stream_folder(spark)
    store = TimelineStore(spark, f"{folder}/store")
    stream_payloads(
        store, _arrival_stream(spark, sf_dir), f"{folder}/checkpoint", "events"
    ).awaitTermination()
    return plain(store.snapshot().windows)


def q_dimension_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _stream_folder(spark)
    stream_dimension(
        _arrival_stream(spark, sf_dir), f"{folder}/result", f"{folder}/checkpoint"
    ).awaitTermination()
    return plain(running_result(spark, f"{folder}/result").select(*WINDOW.names))


def q_summary_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _stream_folder(spark)
    stream_summary(
        _arrival_stream(spark, sf_dir), f"{folder}/result", f"{folder}/checkpoint"
    ).awaitTermination()
    return _summary_row(running_result(spark, f"{folder}/result"))


# Lookups and joins.


def q_event_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(stored(spark, sf_dir).event(EVENT_ID).select(*EVENT_COLUMNS))


def q_window_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(stored(spark, sf_dir).window(WINDOW_ID))


def q_window_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(stored(spark, sf_dir).window_by_hash(_hash_of_user(spark, sf_dir)))


def q_events_with_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir)
    window_columns = [name for name in WINDOW.names if name != "window_id"]
    return plain(
        timeline.all_records(s.log, s.windows).select(
            *[F.col(f"event.{name}").alias(name) for name in EVENT_COLUMNS],
            F.col("window").isNotNull().alias("has_window"),
            *[F.col(f"window.{name}").alias(name) for name in window_columns],
        )
    )


def q_events_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = EventQuery(context_hash=_hash_of_user(spark, sf_dir))
    return _matching(query)(spark, sf_dir)


def q_windows_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = WindowQuery(context_hash=_hash_of_user(spark, sf_dir))
    return _listed_windows(query)(spark, sf_dir)


def q_events_all_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    hash_of_user = _hash_of_user(spark, sf_dir)
    window_id = stored(spark, sf_dir).window_by_hash(hash_of_user).first()["window_id"]
    query = EventQuery(
        start_at=START,
        end_at="2024-01-25T00:00:00Z",
        kind="button_press",
        window_id=window_id,
        search="  pP 7 ",
        app_name="App 7",
        context_hash=hash_of_user,
    )
    return _matching(query)(spark, sf_dir)


def q_events_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir)
    return timeline.count_events(s.log, s.windows, EventQuery(start_at=START, search="app 1"))


def q_events_page_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = EventQuery(kind="wheel", cursor=130, size=60)
    return timeline.page_info(stored(spark, sf_dir).list_events(query))


def q_windows_page_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = WindowQuery(search="app 1", page=2, size=7)
    return timeline.page_info(stored(spark, sf_dir).list_windows(query))


def q_events_sorted_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of every event in the default list order."""
    order = timeline.sort_keys("occurred_at", "event_id", "desc")
    log = stored(spark, sf_dir).log.select("event_id", "occurred_at")
    return number_rows(log, order, "pos", start=0).select("pos", "event_id")


# Summary.


def _summary_row(df: DataFrame) -> DataFrame:
    """The summary as one flat row; shares are compared in `top_apps`."""
    entries = F.transform(
        "top_apps",
        lambda app: F.concat_ws("=", app["app_name"], app["event_count"].cast("string")),
    )
    return summary.with_pointer_events(df).withColumn("top_apps", F.array_join(entries, ";"))


def _totals(query: SummaryQuery) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = stored(spark, sf_dir)
        return summary.summary_totals(s.log, s.windows, query)

    return run


def _top(query: SummaryQuery) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = stored(spark, sf_dir)
        return summary.top_apps(s.log, s.windows, query).withColumn("pos", F.col("pos").cast("bigint"))

    return run


_days: dict[tuple[str, str], rollup.DayPartials] = {}


def _day_partials(spark: SparkSession, sf_dir: str) -> rollup.DayPartials:
    """Partials of the stored log, of two batches that share days, written once."""
    key = (prepare(spark).sparkContext.applicationId, sf_dir)
    if key not in _days:
        s = stored(spark, sf_dir)
        even, odd = (s.log.where(F.col("event_id") % 2 == k) for k in (0, 1))
        both = rollup.day_partials(even, s.windows).merged(rollup.day_partials(odd, s.windows))
        _days[key] = rollup.DayPartials(materialise(both.apps), materialise(both.seen))
    return _days[key]


def _from_days(query: SummaryQuery) -> Query:
    """One flat row of a range, merged from day partials and the days that the range cuts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = stored(spark, sf_dir)
        return _summary_row(rollup.summary_from_days(_day_partials(spark, sf_dir), s.log, s.windows, query))

    return run


def q_activity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary_row(stored(spark, sf_dir).summary())


def q_last_event_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(stored(spark, sf_dir).last_event_at())


# Views.


def q_recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir)
    return plain(views.recent_events(s.log, s.windows))


def q_event_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir)
    detail = views.event_detail(s.log, s.windows, EVENT_ID)
    return plain(
        detail.select(
            *EVENT_COLUMNS,
            "value",
            "raw_event_is_json",
            "raw_window_is_json",
            F.col("window.app_name").alias("app_name"),
            F.col("window.event_count").alias("window_event_count"),
        )
    )


def q_window_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir)
    return _event_page(views.window_events(s.log, s.windows, WINDOW_ID))


def q_event_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir)
    return plain(views.list_items(timeline.all_records(s.log, s.windows)))


def q_event_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir)
    records = timeline.all_records(s.log, s.windows)
    return views.event_display(records, zone="Asia/Shanghai", language="zh-CN")


def q_window_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.window_display(stored(spark, sf_dir).windows)


def q_raw_json_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third raw text is cut short, every third has a second value behind it."""
    props = F.col("props")
    third = F.col("event_id") % 3
    text = (
        F.when(third == 0, props.substr(F.lit(1), F.length(props) - 1))
        .when(third == 1, F.concat(props, F.lit(" {}")))
        .otherwise(props)
    )
    return given_events(spark, sf_dir).select("event_id", is_valid_json(text).alias("is_json"))


# Capture and ingest.


def q_capture_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = normalise_capture(captures(given_events(spark, sf_dir)))
    return plain(
        payloads.select(
            "event_id", "occurred_at", "kind", "value", "delta_x", "delta_y",
            "window.*", "collector_name", "collector_version",
        )
    )


def q_capture_raw_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw texts read back field by field."""
    payloads = normalise_capture(captures(given_events(spark, sf_dir)))
    event = F.parse_json("raw_event")
    window = F.parse_json("raw_window")
    text = lambda v, path: F.variant_get(v, path, "string")
    return payloads.select(
        "event_id",
        F.array_size(F.json_object_keys("raw_event")).alias("event_fields"),
        text(event, "$.kind").alias("kind"),
        text(event, "$.value").alias("value"),
        F.variant_get(event, "$.delta_x", "double").alias("delta_x"),
        F.variant_get(event, "$.delta_y", "double").alias("delta_y"),
        text(event, "$.key_name").alias("key_name"),
        text(event, "$.occurred_at").alias("occurred_text"),
        text(event, "$.collector_name").alias("collector_name"),
        text(event, "$.collector_version").alias("collector_version"),
        F.array_size(F.json_object_keys("raw_window")).alias("window_fields"),
        text(window, "$.app_name").alias("app_name"),
        text(window, "$.title").alias("title"),
        text(window, "$.process_path").alias("process_path"),
        F.variant_get(window, "$.process_id", "bigint").alias("process_id"),
        F.variant_get(window, "$.position.x", "double").alias("x"),
        F.variant_get(window, "$.size.height", "double").alias("height"),
    )


def wire_lines(events: DataFrame) -> DataFrame:
    """The given events as wire lines; by event id, 8 in 20 are damaged, one lacks the prefix
    and one is padded with white space.
    """
    payloads = arrivals(events).withColumn(
        "raw_event", F.concat(F.lit('{"event_id":'), F.col("event_id"), F.lit("}"))
    )
    line = to_wire(payloads.drop("event_id"), PREFIX)
    lines = line.withColumn(
        "fault", F.regexp_extract("value", r'event_id\\":(\d+)', 1).cast("bigint") % 20
    )
    value, fault = F.col("value"), F.col("fault")
    replaced = lambda old, new: F.regexp_replace(value, old, new)
    return lines.select(
        F.when(fault == 0, value.substr(F.lit(1), F.length(value) - 20))
        .when(fault == 1, replaced(r'"kind":"[a-z_]*"', '"kind":"key_hold"'))
        .when(fault == 2, replaced(r'"value":"[^"]*"', '"value":5'))
        .when(fault == 3, replaced(r'"collector_name":"[^"]*",', ""))
        .when(fault == 4, replaced(r'"window":(null|\{[^}]*\})', '"window":{"app_name":"App"}'))
        .when(fault == 5, replaced(r'"window":(null|\{[^}]*\})',
              '"window":{"app_name":"App","title":"t","process_id":-1}'))
        .when(fault == 6, replaced(r'Z","kind"', '","kind"'))
        .when(fault == 7, F.concat(value, F.lit(" {}")))
        .when(fault == 8, F.substring(value, 2, 2**31 - 1))
        .when(fault == 9, F.concat(F.lit(" \t　"), value, F.lit("　 ")))
        .otherwise(value)
        .alias("value")
    )


_feeds: dict[tuple[str, str], DataFrame] = {}


def _decoded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wire lines, written once per application and folder as a feed is, and decoded."""
    key = (prepare(spark).sparkContext.applicationId, sf_dir)
    if key not in _feeds:
        _feeds[key] = materialise(wire_lines(given_events(spark, sf_dir)))
    return decode_events(event_lines(_feeds[key], PREFIX))


def q_ingest_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = valid_events(_decoded_lines(spark, sf_dir))
    event_id = F.get_json_object("raw_event", "$.event_id").cast("bigint")
    return plain(
        good.select(
            event_id.alias("event_id"), "occurred_at", "kind", "value", "delta_x", "delta_y",
            "window.*", "collector_name", "collector_version",
        )
    )


def q_ingest_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = quarantined(_decoded_lines(spark, sf_dir))
    event_id = F.regexp_extract("payload", r'event_id\\":(\d+)', 1).cast("bigint")
    return bad.select(event_id.alias("event_id"), "reason")


def q_ingest_repeated_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wire lines that give members twice: by event id unknown ones at the top, within the
    window and nested, which are ignored, or known ones at the top or within the window, which
    are refused.
    """
    prepare(spark)
    events = arrivals(given_events(spark, sf_dir))
    line = events.select("event_id", wire_json().alias("value"))
    value, case = F.col("value"), F.col("event_id") % 6
    top = lambda members: F.concat(F.lit("{" + members + ","), F.substring(value, 2, 2**31 - 1))
    inner = lambda members: F.regexp_replace(value, r'"window":\{', '"window":{' + members + ",")
    payload = (
        F.when(case == 0, top('"extra":1,"extra":[2]'))
        .when(case == 1, inner('"zoom":1,"zoom":{"zoom":2}'))
        .when(case == 2, top('"kind":"wheel"'))
        .when(case == 3, inner('"title":"other"'))
        .when(case == 4, top('"extra":{"kind":1,"kind":2,"window":{"title":1,"title":2}}'))
        .otherwise(top(r'"k\u0069nd":"wheel"'))
    )
    decoded = decode_events(line.select("event_id", payload.alias("payload")))
    taken = F.col("reason").isNull()
    return decoded.select(
        "event_id",
        F.coalesce("reason", F.lit("valid")).alias("state"),
        F.when(taken, F.col("kind")).alias("kind"),
        F.when(taken, F.col("window.title")).alias("title"),
    )


def q_raw_json_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third raw text repeats members at two levels, every third nests deeply, every
    third breaks off behind a repeated member.
    """
    prepare(spark)
    props = F.col("props")
    third = F.col("event_id") % 3
    depth = (F.col("event_id") % 900).cast("int")
    text = (
        F.when(third == 0, F.concat(F.lit('{"a":'), props, F.lit(',"b":{"c":1,"c":2},"a":0}')))
        .when(third == 1, F.concat(F.repeat(F.lit("["), depth), props, F.repeat(F.lit("]"), depth)))
        .otherwise(F.concat(F.lit('{"a":'), props, F.lit(',"a":}')))
    )
    return given_events(spark, sf_dir).select(
        "event_id",
        is_valid_json(text).alias("is_json"),
        F.concat_ws(",", repeated_members(text, ("a", "b", "c"))).alias("repeated"),
    )


# The front door: a feed of text files into a store, and events without or with odd ids.


_line_stores: dict[tuple[str, str], TimelineStore] = {}


def _feed_folder(spark: SparkSession, sf_dir: str) -> str:
    """The wire lines as several text files in the shared folder."""
    folder = f"{_stream_folder(spark)}/feed"
    wire_lines(given_events(spark, sf_dir)).repartition(FEED_FILES).write.text(folder)
    return folder


def _line_store(spark: SparkSession, sf_dir: str) -> TimelineStore:
    """A store that took the feed in one batch, built once per application and folder."""
    key = (prepare(spark).sparkContext.applicationId, sf_dir)
    if key not in _line_stores:
        _line_stores[key] = build_line_store(spark, sf_dir)
    return _line_stores[key]


def build_line_store(spark: SparkSession, sf_dir: str) -> TimelineStore:
    store = TimelineStore(spark, f"{_stream_folder(spark)}/store")
    store.ingest_lines(read_lines(spark, _feed_folder(spark, sf_dir)), PREFIX)
    return store


def _events_of_lines(s: Snapshot) -> DataFrame:
    """Stored events by the id they were written with, joined with their windows."""
    named = s.windows.select("window_id", "app_name", "process_path", "process_id", "title")
    joined = s.events.join(named, "window_id", "left")
    return plain(
        joined.select(
            F.get_json_object("raw_event", "$.event_id").cast("bigint").alias("event_id"),
            "occurred_at", "event_kind", "event_value", "delta_x", "delta_y",
            "app_name", "process_path", "process_id", "title",
            "collector_name", "collector_version",
        )
    )


def q_lines_to_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events_of_lines(_line_store(spark, sf_dir).snapshot())


def q_lines_quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = _line_store(spark, sf_dir).quarantine()
    event_id = F.regexp_extract("payload", r'event_id\\":(\d+)', 1).cast("bigint")
    return bad.select(event_id.alias("event_id"), "reason")


def q_lines_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as a stream whose checkpoint is lost before the last file comes."""
    folder, feed = _stream_folder(spark), _feed_folder(spark, sf_dir)
    store = TimelineStore(spark, f"{folder}/store")
    first = read_lines(spark, f"{feed}/part-0000[0-2]*", streaming=True, maxFilesPerTrigger=2)
    stream_lines(store, first, f"{folder}/lost", "feed", PREFIX).awaitTermination()
    whole = read_lines(spark, feed, streaming=True)
    stream_lines(store, whole, f"{folder}/checkpoint", "feed", PREFIX).awaitTermination()
    return _events_of_lines(store.snapshot())


def q_ingest_without_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured events carry no ids: the store gives them, over two batches."""
    given = arrivals(given_events(spark, sf_dir)).withColumnRenamed("event_id", "sequence")
    middle = given.agg(F.avg("sequence")).first()[0] or 0
    store = TimelineStore(spark, f"{_stream_folder(spark)}/store")
    store.ingest(given.where(F.col("sequence") < middle), order_by=["sequence"])
    s = store.ingest(given.where(F.col("sequence") >= middle), order_by=["sequence"])
    return plain(s.events.select("event_id", "occurred_at", "event_kind", "event_value", "window_id"))


def _repeated_store(spark: SparkSession, sf_dir: str) -> TimelineStore:
    """Every tenth event twice in one batch, every seventh once more in the next."""
    given = arrivals(given_events(spark, sf_dir))
    store = TimelineStore(spark, f"{_stream_folder(spark)}/store")
    store.ingest(given.union(given.where("event_id % 10 = 0")))
    store.ingest(given.where("event_id % 7 = 0"))
    return store


def q_ingest_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each id was stored and refused."""
    store = _repeated_store(spark, sf_dir)
    kept = store.snapshot().events.select("event_id", F.lit("stored").alias("state"))
    refused = store.quarantine().select("event_id", F.col("reason").alias("state"))
    return kept.union(refused).groupBy("event_id", "state").agg(F.count(F.lit(1)).alias("rows"))


def q_dimension_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches, a compaction, and one more batch."""
    given = arrivals(given_events(spark, sf_dir))
    first, last = given.agg(F.min("event_id"), F.max("event_id")).first()
    store = TimelineStore(spark, f"{_stream_folder(spark)}/store")
    step = (last - first) // 5 + 1
    for number, low in enumerate(range(first, last + 1, step)):
        if number == 4:
            store.compact()
        store.ingest(given.where(F.col("event_id").between(low, low + step - 1)))
    return plain(store.snapshot().windows)


#: Factor and divisor that make deltas of all sizes out of given values, correctly rounded.
SCALES = (
    (1.0, 1.0), (1.0, 10.0), (1.0, 1e3), (1.0, 1e8), (1e5, 1.0), (1e13, 1.0), (1e16, 1.0),
    (1e22, 1.0), (1.0, 1e22), (-1.0, 8.0), (0.0, 1.0),
)


def q_wheel_value_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shown text of wheel events whose deltas are fractions, tiny, and very large."""
    base = F.floor(F.col("value") * 100).cast("double")

    def delta(shift: int) -> Column:
        place = (F.col("event_id") + shift) % len(SCALES)
        factor, divisor = (F.array(*[F.lit(s[i]) for s in SCALES])[place] for i in (0, 1))
        return base * factor / divisor

    text = views.shown_value(F.lit("wheel"), F.lit(""), delta(0), delta(3))
    return given_events(spark, sf_dir).select("event_id", text.alias("shown"))


# Constraints and free SQL.


def q_constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).constraint_report()


def q_constraint_report_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored tables with faults put in."""
    s = stored(spark, sf_dir)
    event_id = F.col("event_id")
    events = s.events.withColumns(
        {
            "event_kind": F.when(event_id % 97 == 0, F.lit("key_hold")).otherwise(F.col("event_kind")),
            "event_value": F.when(event_id % 89 != 0, F.col("event_value")),
            "window_id": F.when(event_id % 83 == 0, F.lit(-1)).otherwise(F.col("window_id")),
            "event_id": F.when(event_id % 101 == 0, event_id + 1).otherwise(event_id),
        }
    )
    windows = s.windows.withColumns(
        {
            "title": F.when(F.col("window_id") % 6 != 0, F.col("title")),
            "context_hash": F.when(F.col("window_id") % 5 == 0, F.lit("v1-0")).otherwise(
                F.col("context_hash")
            ),
        }
    )
    return constraint_report(events, windows)


FREE_SQL = """
    SELECT w.title AS title, count(*) AS events, max(e.occurred_at) AS newest
    FROM input_events e JOIN observed_windows w ON e.window_id = w.window_id
    WHERE e.event_kind = :kind
    GROUP BY w.title
"""


def q_free_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(stored(spark, sf_dir).sql(FREE_SQL, {"kind": "wheel"}))


# Further down the given 10,000 events than a top-k goes.
DEEP_CURSOR = 6_200


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        name.removeprefix("q_"): value
        for name, value in globals().items()
        if name.startswith("q_")
    }
    found |= {
        "events_from": _matching(EventQuery(start_at=START)),
        "events_until": _matching(EventQuery(end_at=END)),
        "events_range": _matching(EventQuery(start_at=START, end_at=END)),
        "events_empty_range": _matching(EventQuery(start_at=END, end_at=START)),
        "events_by_kind": _matching(EventQuery(kind="wheel")),
        "events_by_window": _matching(EventQuery(window_id=WINDOW_ID)),
        "events_search": _matching(EventQuery(search=" aPP 1 ")),
        "events_search_wildcard": _matching(EventQuery(search="p%1_")),
        "events_search_backslash": _matching(EventQuery(search="App\\")),
        "events_search_blank": _matching(EventQuery(search=" 　 ")),
        "events_by_app": _matching(EventQuery(app_name="App 3")),
        "events_page": _listed(EventQuery(page=2, size=25)),
        "events_page_filtered": _listed(
            EventQuery(page=3, size=40, start_at=START, kind="wheel", search="app")
        ),
        "events_cursor": _listed(EventQuery(page=9, cursor=30, size=20)),
        "events_past_end": _listed(EventQuery(page=10**9, size=100)),
        "events_size_clamped": _listed(EventQuery(size=5000)),
        "windows_search": _listed_windows(WindowQuery(search="pp 1")),
        "windows_by_app": _listed_windows(WindowQuery(app_name="App 3")),
        "windows_page": _listed_windows(WindowQuery(page=2, size=5)),
        "windows_cursor": _listed_windows(WindowQuery(cursor=3, size=4)),
        "summary_days": _from_days(SummaryQuery()),
        "summary_days_range": _from_days(SummaryQuery(START, END)),
        "summary_days_cut": _from_days(SummaryQuery(CUT_START, CUT_END)),
        "summary_days_one": _from_days(SummaryQuery(CUT_START, SAME_DAY)),
        "summary_days_empty": _from_days(EMPTY_RANGE),
        "summary_totals": _totals(SummaryQuery()),
        "summary_totals_range": _totals(SummaryQuery(START, END)),
        "summary_empty_range": _totals(EMPTY_RANGE),
        "top_apps": _top(SummaryQuery()),
        "top_apps_range": _top(SummaryQuery(START, END)),
        "top_apps_empty_range": _top(EMPTY_RANGE),
    }
    for direction in ("asc", "desc"):
        for key in timeline.EVENT_SORTS:
            found[f"events_deep_{key}_{direction}"] = _listed(
                EventQuery(sort_by=key, sort_direction=direction, cursor=DEEP_CURSOR, size=400)
            )
            found[f"events_sort_{key}_{direction}"] = _listed(
                EventQuery(
                    cursor=EVENT_SORT_CURSOR, size=SORT_SIZE, sort_by=key, sort_direction=direction
                )
            )
        for key in timeline.WINDOW_SORTS:
            found[f"windows_sort_{key}_{direction}"] = _listed_windows(
                WindowQuery(
                    cursor=WINDOW_SORT_CURSOR, size=SORT_SIZE, sort_by=key, sort_direction=direction
                )
            )
    return found
