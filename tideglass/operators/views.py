"""Projections for lists, details and display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.functions.rawjson import is_valid_json
from tideglass.functions.text import number_text, round_half_up
from tideglass.functions.times import compact_text
from tideglass.operators.timeline import (
    EventQuery,
    Page,
    event_by_id,
    joined_records,
    list_events,
    window_by_id,
)
from tideglass.schemas import RECENT_EVENTS, UNKNOWN_APP, WHEEL_KIND

# Labels of the event kinds per language.
KIND_LABELS = {
    "en-US": {
        "key_press": "Key press",
        "key_release": "Key release",
        "button_press": "Button press",
        "button_release": "Button release",
        "wheel": "Wheel",
    },
    "zh-CN": {
        "key_press": "按键按下",
        "key_release": "按键释放",
        "button_press": "鼠标按下",
        "button_release": "鼠标释放",
        "wheel": "滚轮",
    },
}

WINDOW_EVENTS_PAGE_SIZE = 25


def shown_value(kind: Column, value: Column, delta_x: Column, delta_y: Column) -> Column:
    """The stored value; a wheel event without one shows its deltas instead."""
    zero = F.lit(0.0)
    deltas = F.concat(
        F.lit("delta_x:"),
        number_text(F.coalesce(delta_x, zero)),
        F.lit(", delta_y:"),
        number_text(F.coalesce(delta_y, zero)),
    )
    return F.when((kind == WHEEL_KIND) & (value == ""), deltas).otherwise(value)


def _value_of(row: str = "") -> Column:
    names = ("event_kind", "event_value", "delta_x", "delta_y")
    return shown_value(*[F.col(row + name) for name in names])


def _pos_of(records: DataFrame) -> list[str]:
    return [name for name in records.columns if name == "pos"]


def list_items(records: DataFrame) -> DataFrame:
    """List rows from joined records (`event`, `window`, and `pos` if they are a page)."""
    return records.select(
        *_pos_of(records),
        F.col("event.event_id").alias("id"),
        F.col("event.occurred_at").alias("occurred_at"),
        F.col("event.event_kind").alias("kind"),
        _value_of("event.").alias("value"),
        F.coalesce("window.app_name", F.lit(UNKNOWN_APP)).alias("app_name"),
        F.coalesce("window.title", F.lit("")).alias("window_title"),
        F.col("event.collector_name").alias("collector_name"),
        F.col("event.collector_version").alias("collector_version"),
        F.col("event.window_id").alias("window_id"),
    )


def recent_events(events: DataFrame, windows: DataFrame) -> DataFrame:
    """The newest events, seven columns and their position."""
    page = list_events(events, windows, EventQuery(page=1, size=RECENT_EVENTS))
    return list_items(page.rows).drop("collector_name", "collector_version")


def event_detail(events: DataFrame, windows: DataFrame, event_id: int) -> DataFrame:
    """One event with its shown value and raw texts, and its window or NULL."""
    event = event_by_id(events, event_id).withColumns(
        {
            "value": _value_of(),
            "raw_event_is_json": is_valid_json(F.col("raw_event")),
            "raw_window_is_json": is_valid_json(F.col("raw_window")),
        }
    )
    # One event has at most one window, so look its id up first.
    found = event.select("window_id").first()
    wanted = -1 if found is None or found[0] is None else found[0]
    return joined_records(event, window_by_id(windows, wanted))


def window_detail(windows: DataFrame, window_id: int) -> DataFrame:
    return window_by_id(windows, window_id)


def window_events(
    events: DataFrame,
    windows: DataFrame,
    window_id: int,
    page: int = 1,
    size: int = WINDOW_EVENTS_PAGE_SIZE,
) -> Page:
    """A window's events, newest first."""
    return list_events(
        events, windows, EventQuery(page=page, size=size, window_id=window_id)
    )


def kind_label(kind: Column, language: str = "en-US") -> Column:
    labels = KIND_LABELS[language]
    pairs = [F.lit(text) for pair in labels.items() for text in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), kind)


def size_text(width: Column, height: Column) -> Column:
    return _pair_text(width, height, " x ")


def position_text(x: Column, y: Column) -> Column:
    return _pair_text(x, y, ", ")


def _pair_text(first: Column, second: Column, between: str) -> Column:
    text = F.concat(
        round_half_up(first).cast("string"), F.lit(between), round_half_up(second).cast("string")
    )
    return F.coalesce(text, F.lit("-"))


def event_display(records: DataFrame, zone: str = "UTC", language: str = "en-US") -> DataFrame:
    """Display texts of joined records."""
    return records.select(
        *_pos_of(records),
        F.col("event.event_id").alias("id"),
        compact_text(F.col("event.occurred_at"), zone).alias("occurred_text"),
        kind_label(F.col("event.event_kind"), language).alias("kind_label"),
        _value_of("event.").alias("value"),
        F.concat_ws(" ", "event.collector_name", "event.collector_version").alias("collector"),
    )


def window_display(windows: DataFrame, zone: str = "UTC") -> DataFrame:
    """Display texts of dimension rows."""
    return windows.select(
        "window_id",
        size_text(F.col("width"), F.col("height")).alias("size_text"),
        position_text(F.col("x"), F.col("y")).alias("position_text"),
        compact_text(F.col("first_seen_at"), zone).alias("first_seen_text"),
        compact_text(F.col("last_seen_at"), zone).alias("last_seen_text"),
    )
