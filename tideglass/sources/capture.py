"""Raw capture records to events: kinds, values, deltas, window fields, raw JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideglass.functions.rawjson import raw_event_json, raw_window_json
from tideglass.functions.text import blank_to_null, trim_text
from tideglass.schemas import DEFAULT_COLLECTOR_NAME, PAYLOAD, PROCESS_ID, WINDOW_SNAPSHOT

# What a capture hook reports: the time in microseconds since the epoch, the type of
# input, the key or button, the typed text, wheel steps, and the window in focus.
CAPTURE = T.StructType(
    [
        T.StructField("time_us", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("detail", T.StringType()),
        T.StructField("key_name", T.StringType()),
        T.StructField("delta_x", T.LongType()),
        T.StructField("delta_y", T.LongType()),
        T.StructField(
            "window",
            T.StructType(
                [
                    T.StructField("title", T.StringType()),
                    T.StructField("app_name", T.StringType()),
                    T.StructField("process_path", T.StringType()),
                    T.StructField("process_id", PROCESS_ID),
                    T.StructField(
                        "position",
                        T.StructType(
                            [T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]
                        ),
                    ),
                    T.StructField(
                        "size",
                        T.StructType(
                            [
                                T.StructField("width", T.DoubleType()),
                                T.StructField("height", T.DoubleType()),
                            ]
                        ),
                    ),
                ]
            ),
        ),
    ]
)

# Captured types that become events; pointer moves and others do not.
KIND_OF_TYPE = {
    "KeyPress": "key_press",
    "KeyRelease": "key_release",
    "ButtonPress": "button_press",
    "ButtonRelease": "button_release",
    "Wheel": "wheel",
}


def clean_window(window: Column) -> Column:
    """Trim the title; a missing or blank one is ''."""
    title = F.coalesce(trim_text(window["title"]), F.lit(""))
    return F.when(window.isNotNull(), window.withField("title", title))


def window_snapshot(window: Column) -> Column:
    """Flatten position and size; an empty path becomes NULL."""
    flat = F.struct(
        window["app_name"].alias("app_name"),
        blank_to_null(window["process_path"]).alias("process_path"),
        window["process_id"].alias("process_id"),
        window["title"].alias("title"),
        window["position"]["x"].alias("x"),
        window["position"]["y"].alias("y"),
        window["size"]["width"].alias("width"),
        window["size"]["height"].alias("height"),
    ).cast(WINDOW_SNAPSHOT)
    return F.when(window.isNotNull(), flat)


def normalise_capture(
    raw: DataFrame,
    collector_name: str = DEFAULT_COLLECTOR_NAME,
    collector_version: str = "0.1.0",
) -> DataFrame:
    """Keep the five kinds of input and shape them as payloads; other columns pass through."""
    extra = [name for name in raw.columns if name not in CAPTURE.names]
    wheel = F.col("event_type") == "Wheel"
    kinds = F.create_map(*[F.lit(t) for pair in KIND_OF_TYPE.items() for t in pair])
    steps = F.concat(
        F.lit("delta_x:"), F.col("delta_x").cast("string"),
        F.lit(", delta_y:"), F.col("delta_y").cast("string"),
    )
    shaped = raw.where(F.col("event_type").isin(*KIND_OF_TYPE)).select(
        *extra,
        F.timestamp_micros("time_us").alias("occurred_at"),
        F.try_element_at(kinds, F.col("event_type")).alias("kind"),
        F.when(wheel, steps).otherwise(F.col("detail")).alias("value"),
        F.when(wheel, F.col("delta_x").cast("double")).alias("delta_x"),
        F.when(wheel, F.col("delta_y").cast("double")).alias("delta_y"),
        "key_name",
        clean_window(F.col("window")).alias("captured"),
        F.lit(collector_name).alias("collector_name"),
        F.lit(collector_version).alias("collector_version"),
    )
    event_fields = (
        "kind", "value", "delta_x", "delta_y", "key_name",
        "occurred_at", "collector_name", "collector_version",
    )
    return shaped.withColumns(
        {
            "window": window_snapshot(F.col("captured")),
            "raw_event": raw_event_json(*[F.col(name) for name in event_fields]),
            "raw_window": raw_window_json(F.col("captured")),
        }
    ).select(*extra, *PAYLOAD.names)
