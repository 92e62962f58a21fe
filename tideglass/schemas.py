"""Column names, types and limits of the timeline model."""

from __future__ import annotations

from pyspark.sql import types as T

# The closed set of event kinds, and its groups.
EVENT_KINDS = ("key_press", "key_release", "button_press", "button_release", "wheel")
KEY_KINDS = ("key_press", "key_release")
BUTTON_KINDS = ("button_press", "button_release")
WHEEL_KIND = "wheel"

# Column defaults, page limits, size of the top list, name of the
# bucket of events without a window.
DEFAULT_COLLECTOR_NAME = "listener"
DEFAULT_COLLECTOR_VERSION = "unknown"
DEFAULT_PAGE = 1
DEFAULT_PAGE_SIZE = 100
MAX_PAGE_SIZE = 1000
TOP_APPS_LIMIT = 10
RECENT_EVENTS = 10
UNKNOWN_APP = "Unknown"

# Unsigned 64-bit process ids need 20 digits.
PROCESS_ID = T.DecimalType(20, 0)

IDENTITY = ("app_name", "process_id", "process_path", "title")
GEOMETRY = ("x", "y", "width", "height")


def _field(name: str, dtype: T.DataType, nullable: bool = True) -> T.StructField:
    return T.StructField(name, dtype, nullable)


# Snapshot of the window in focus, as it travels inside an event.
WINDOW_SNAPSHOT = T.StructType(
    [
        _field("app_name", T.StringType()),
        _field("process_path", T.StringType()),
        _field("process_id", PROCESS_ID),
        _field("title", T.StringType()),
        _field("x", T.DoubleType()),
        _field("y", T.DoubleType()),
        _field("width", T.DoubleType()),
        _field("height", T.DoubleType()),
    ]
)

# One event as a collector sends it.
PAYLOAD = T.StructType(
    [
        _field("occurred_at", T.TimestampType()),
        _field("kind", T.StringType()),
        _field("value", T.StringType()),
        _field("delta_x", T.DoubleType()),
        _field("delta_y", T.DoubleType()),
        _field("window", WINDOW_SNAPSHOT),
        _field("raw_event", T.StringType()),
        _field("raw_window", T.StringType()),
        _field("collector_name", T.StringType()),
        _field("collector_version", T.StringType()),
    ]
)

# The stored event log.
EVENT = T.StructType(
    [
        _field("event_id", T.LongType()),
        _field("occurred_at", T.TimestampType()),
        _field("event_kind", T.StringType()),
        _field("event_value", T.StringType()),
        _field("delta_x", T.DoubleType()),
        _field("delta_y", T.DoubleType()),
        _field("window_id", T.LongType()),
        _field("raw_event", T.StringType()),
        _field("raw_window", T.StringType()),
        _field("collector_name", T.StringType()),
        _field("collector_version", T.StringType()),
        _field("created_at", T.TimestampType()),
    ]
)

# The stored window dimension.
WINDOW = T.StructType(
    [
        _field("window_id", T.LongType()),
        _field("app_name", T.StringType()),
        _field("process_path", T.StringType()),
        _field("process_id", PROCESS_ID),
        _field("title", T.StringType()),
        _field("x", T.DoubleType()),
        _field("y", T.DoubleType()),
        _field("width", T.DoubleType()),
        _field("height", T.DoubleType()),
        _field("first_seen_at", T.TimestampType()),
        _field("last_seen_at", T.TimestampType()),
        _field("event_count", T.LongType()),
        _field("context_hash", T.StringType()),
    ]
)

# What the dimension keeps besides its public columns, so that later batches can
# be folded in: the arrival positions of the first and the last event.
WINDOW_STATE = T.StructType(
    WINDOW.fields
    + [_field("first_event_id", T.LongType()), _field("last_event_id", T.LongType())]
)

REQUIRED_EVENT_COLUMNS = (
    "event_id",
    "occurred_at",
    "event_kind",
    "event_value",
    "collector_name",
    "collector_version",
    "created_at",
)
REQUIRED_WINDOW_COLUMNS = (
    "window_id",
    "app_name",
    "title",
    "first_seen_at",
    "last_seen_at",
    "event_count",
    "context_hash",
)
