"""The given `events` table in the shape of the timeline model."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.schemas import PAYLOAD, PROCESS_ID
from tideglass.session import prepare, scratch_folder
from tideglass.store import Snapshot, TimelineStore

# How the given event types stand for kinds and for captured types.
KIND_OF_EVENT_TYPE = {
    "signup": "key_press",
    "purchase": "key_release",
    "click": "button_press",
    "error": "button_release",
    "view": "wheel",
}
CAPTURE_OF_EVENT_TYPE = {
    "signup": "KeyPress",
    "purchase": "KeyRelease",
    "click": "ButtonPress",
    "error": "ButtonRelease",
    "view": "Wheel",
}


def given_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/events.parquet")


def _lookup(mapping: dict[str, str], key: str) -> Column:
    pairs = [F.lit(text) for pair in mapping.items() for text in pair]
    return F.try_element_at(F.create_map(*pairs), F.col(key))


def _shifted_time() -> Column:
    """Event times that run up to ten days behind the order of arrival."""
    seconds = ((F.col("event_id") * 7919) % 864000).cast("int")
    return F.col("ts") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def arrivals(events: DataFrame) -> DataFrame:
    """Payloads with `event_id` from the given events."""
    event_id, user = F.col("event_id"), F.col("user_id")
    kind = _lookup(KIND_OF_EVENT_TYPE, "event_type")
    wheel = kind == "wheel"
    app_number = (user % 12).cast("string")
    window = F.struct(
        F.concat(F.lit("App "), app_number).alias("app_name"),
        F.when(user % 3 != 0, F.concat(F.lit("/opt/app"), app_number)).alias("process_path"),
        user.cast(PROCESS_ID).alias("process_id"),
        F.concat(F.lit("Doc "), (user % 40).cast("string")).alias("title"),
        F.when(event_id % 4 != 0, F.col("value")).alias("x"),
        F.when(event_id % 4 != 0, -F.col("value")).alias("y"),
        F.lit(1280.0).alias("width"),
        F.lit(720.0).alias("height"),
    )
    return events.select(
        "event_id",
        _shifted_time().cast("timestamp").alias("occurred_at"),
        kind.alias("kind"),
        F.when(wheel & (event_id % 2 == 0), F.lit(""))
        .when(wheel, F.lit("delta_x:0, delta_y:1"))
        .otherwise(F.concat(F.lit("Key"), (event_id % 26).cast("string")))
        .alias("value"),
        F.when(wheel, F.lit(0.0)).alias("delta_x"),
        F.when(wheel, F.lit(1.0)).alias("delta_y"),
        F.when(user % 10 != 0, window).alias("window"),
        F.col("props").alias("raw_event"),
        F.lit(None).cast("string").alias("raw_window"),
        F.lit("listener").alias("collector_name"),
        F.lit("unknown").alias("collector_version"),
    ).select("event_id", *PAYLOAD.names)


def captures(events: DataFrame) -> DataFrame:
    """Raw capture records with `event_id`: pointer moves, odd types, padded and blank titles."""
    event_id, user = F.col("event_id"), F.col("user_id")
    kind = _lookup(CAPTURE_OF_EVENT_TYPE, "event_type")
    app_number = (user % 12).cast("string")
    window = F.struct(
        F.when(event_id % 5 == 0, F.lit("  \t"))
        .when(event_id % 5 == 1, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("　 Doc "), (user % 40).cast("string"), F.lit(" \n")))
        .alias("title"),
        F.concat(F.lit("App "), app_number).alias("app_name"),
        F.when(user % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("/opt/app"), app_number))
        .alias("process_path"),
        user.cast(PROCESS_ID).alias("process_id"),
        F.struct(F.col("value").alias("x"), (-F.col("value")).alias("y")).alias("position"),
        F.struct(F.lit(1280.0).alias("width"), F.lit(720.0).alias("height")).alias("size"),
    )
    return events.select(
        "event_id",
        F.unix_micros(_shifted_time().cast("timestamp")).alias("time_us"),
        F.when(event_id % 11 == 0, F.lit("MouseMove"))
        .when(event_id % 13 == 0, F.lit("Gesture"))
        .otherwise(kind)
        .alias("event_type"),
        F.concat(F.lit("Key"), (event_id % 26).cast("string")).alias("detail"),
        F.when(event_id % 2 == 0, F.lit("k")).alias("key_name"),
        (event_id % 7 - 3).alias("delta_x"),
        (event_id % 5 - 2).alias("delta_y"),
        F.when(user % 10 != 0, window).alias("window"),
    )


_built: dict[tuple[str, str], Snapshot] = {}


def stored(spark: SparkSession, sf_dir: str) -> Snapshot:
    """The given events as a stored timeline, built once per application and folder."""
    key = (prepare(spark).sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built[key] = build_store(spark, sf_dir)
    return _built[key]


def build_store(spark: SparkSession, sf_dir: str) -> Snapshot:
    root = f"{scratch_folder(spark)}/stores/{uuid.uuid4().hex}"
    return TimelineStore(spark, root).ingest(arrivals(given_events(spark, sf_dir)))
