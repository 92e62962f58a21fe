"""Line source: prefixed JSON lines, decoded as strictly as a typed decoder would."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.functions.rawjson import repeated_members, tagged_json, tagged_value
from tideglass.functions.text import trim_text
from tideglass.functions.times import instant_text, parse_instant
from tideglass.operators.lookup import lookup_join
from tideglass.operators.numbering import number_rows
from tideglass.schemas import EVENT_KINDS, PAYLOAD, PROCESS_ID, WINDOW_SNAPSHOT
from tideglass.session import materialise, prepare

MAX_PROCESS_ID = 2**64 - 1

#: The order of arrival of lines of files; other sources name their own columns.
FILE_ORDER = ("file_time", "file_path", "file_start")


def read_lines(
    spark: SparkSession, path: str, streaming: bool = False, **options: str | int
) -> DataFrame:
    """Text lines with the file split they came from, in batch or as a stream."""
    reader = spark.readStream if streaming else spark.read
    return reader.format("text").options(**options).load(path).select(
        "value",
        F.col("_metadata.file_modification_time").alias("file_time"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("file_start"),
    )


def event_lines(lines: DataFrame, prefix: str = "") -> DataFrame:
    """Trim, drop empty lines and lines without the prefix, strip the prefix."""
    trimmed = lines.withColumn("value", trim_text(F.col("value")))
    kept = trimmed.where((F.col("value") != "") & F.col("value").startswith(prefix))
    return kept.withColumn("payload", F.substring("value", len(prefix) + 1, 2**31 - 1)).drop("value")


def number_lines(
    lines: DataFrame, after: int = 0, order_by: Sequence[str] = FILE_ORDER
) -> DataFrame:
    """Add `event_id` in arrival order: by default file time, file, place in the file."""
    return number_placed(materialise(place_lines(lines)), after, order_by)


def place_lines(lines: DataFrame) -> DataFrame:
    """Add each line's place in its task; to be landed before the places are used."""
    return lines.withColumn("_slot", F.monotonically_increasing_id())


def number_placed(
    landed: DataFrame, after: int = 0, order_by: Sequence[str] = FILE_ORDER
) -> DataFrame:
    """Turn the places of landed lines into `event_id`s in the order of `order_by`.

    Lines of files need no sort: a split's lines are neighbours in one task, so one small
    row per split (its size and first place) turns places into ids. That they are is
    checked. Lines of other sources are sorted by the columns given.
    """
    missing = [name for name in order_by if name not in landed.columns]
    if missing:
        raise ValueError(f"no columns {missing}: name the columns that order the lines")
    if tuple(order_by) != FILE_ORDER:
        keys = [F.col(name) for name in (*order_by, "_slot")]
        return number_rows(landed, keys, "event_id", after + 1).drop("_slot")
    splits = landed.groupBy(*FILE_ORDER).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min("_slot").alias("_first"),
        F.max("_slot").alias("_last"),
    )
    # One row per file split: 100 TB in 128 MB splits are under a million rows.
    earlier = Window.orderBy(*FILE_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    shifts = materialise(
        splits.select(
            "file_path",
            "file_start",
            "_rows",
            (F.col("_last") - F.col("_first") + 1 != F.col("_rows")).alias("_torn"),
            (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        )
    )
    if shifts.where("_torn").limit(1).count():
        raise ValueError("lines of a file split were dealt anew before they were numbered")
    return (
        lookup_join(
            landed, shifts.drop("_torn"), ["file_path", "file_start"], weight="_rows", spread="_slot",
            how="inner",
        )
        .withColumn("event_id", F.lit(after + 1) + F.col("_slot") + F.col("_shift"))
        .drop("_slot", "_shift", *FILE_ORDER)
    )


# Members of the wire record by the type each must have.
_TEXT, _OPTIONAL_TEXT, _NUMBER, _PROCESS_ID, _WINDOW = "text", "text?", "number?", "pid?", "window?"
_EVENT_MEMBERS = {
    "occurred_at": _TEXT,
    "kind": _TEXT,
    "value": _TEXT,
    "delta_x": _NUMBER,
    "delta_y": _NUMBER,
    "window": _WINDOW,
    "raw_event": _OPTIONAL_TEXT,
    "raw_window": _OPTIONAL_TEXT,
    "collector_name": _TEXT,
    "collector_version": _TEXT,
}
_WINDOW_MEMBERS = {
    "app_name": _TEXT,
    "process_path": _OPTIONAL_TEXT,
    "process_id": _PROCESS_ID,
    "title": _TEXT,
    "x": _NUMBER,
    "y": _NUMBER,
    "width": _NUMBER,
    "height": _NUMBER,
}
_CAST = {
    _TEXT: "string",
    _OPTIONAL_TEXT: "string",
    _NUMBER: "double",
    _PROCESS_ID: PROCESS_ID.simpleString(),
}


def _spread(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Add computed columns behind a one-element array.

    Like `withColumns`, but neither later columns nor filters are merged into the
    computation, so each of the fields is computed once however often it is used.
    """
    record = F.struct(*[value.alias(name) for name, value in fields.items()])
    return df.select(*df.columns, F.inline(F.array(record)))


def _members(owner: Column, names) -> Column:
    """The members of a JSON object as a struct of variants; NULL for anything else."""
    shape = ", ".join(f"{name}: variant" for name in names)
    return F.try_variant_get(owner, "$", f"struct<{shape}>")


def _typed(owner: str, members: dict[str, str], prefix: str) -> dict[str, Column]:
    """Value and JSON type of each member; absent and null are both 'VOID'."""
    fields = {}
    for name, rule in members.items():
        member = F.col(f"{owner}.{name}")
        fields[f"{prefix}t_{name}"] = F.coalesce(F.schema_of_variant(member), F.lit("VOID"))
        if rule in _CAST:
            fields[f"{prefix}v_{name}"] = F.try_variant_get(member, "$", _CAST[rule])
    return fields


def _accepted(name: str, rule: str, prefix: str) -> Column:
    kind, value = F.col(f"{prefix}t_{name}"), F.col(f"{prefix}v_{name}")
    if rule == _TEXT:
        return kind == "STRING"
    if rule == _OPTIONAL_TEXT:
        return kind.isin("STRING", "VOID")
    if rule == _WINDOW:
        return kind.startswith("OBJECT") | (kind == "VOID")
    if rule == _NUMBER:
        numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        return (kind == "VOID") | (numeric & F.coalesce(F.abs(value) < float("inf"), F.lit(False)))
    # Whole numbers up to 2**63 - 1 are BIGINT; larger ones are 20-digit decimals, which
    # tells them from short decimals such as 42.0.
    whole = (kind == "BIGINT") | kind.rlike(r"^DECIMAL\((19|20),0\)$")
    highest = F.lit(str(MAX_PROCESS_ID)).cast(PROCESS_ID)
    in_range = F.coalesce((value >= 0) & (value <= highest), F.lit(False))
    return (kind == "VOID") | (whole & in_range)


def decode_events(lines: DataFrame) -> DataFrame:
    """Decode `payload`; adds the event's fields and `reason`, NULL for a valid record.

    Each payload is parsed once, into a variant; member types are checked on it, since
    `from_json` would take a number for a text and skip a missing member silently. Members
    the record does not know are ignored, however often they occur and whatever they hold;
    a known member given twice makes a record ambiguous, and it is refused as `not_json`.
    """
    prepare(lines.sparkSession)
    payload = F.col("payload")
    tagged = _spread(lines, {"_pair": tagged_json(payload)})
    parsed = _spread(tagged, {"_json": tagged_value(F.col("_pair"), payload)})
    split = _spread(parsed, {"_event": _members(F.col("_json"), _EVENT_MEMBERS)})
    inner = _spread(split, {"_inner": _members(F.col("_event.window"), _WINDOW_MEMBERS)})
    typed = _spread(
        inner,
        _typed("_event", _EVENT_MEMBERS, "_") | _typed("_inner", _WINDOW_MEMBERS, "_w"),
    )
    timed = _spread(typed, {"occurred_at": parse_instant(F.col("_v_occurred_at"))})

    has_window = F.col("_t_window").startswith("OBJECT")
    # The text of the window's object keeps what its variant no longer tells.
    twice = F.size(repeated_members(payload, _EVENT_MEMBERS)) > 0
    window_text = F.get_json_object(payload, "$.window")
    window_twice = has_window & (F.size(repeated_members(window_text, _WINDOW_MEMBERS)) > 0)
    failures = [
        ("not_json", F.col("_json").isNull()),
        ("not_an_object", F.col("_event").isNull()),
        ("not_json", twice | window_twice),
        *[(f"bad_field:{n}", ~_accepted(n, rule, "_")) for n, rule in _EVENT_MEMBERS.items()],
        ("bad_field:occurred_at", F.col("occurred_at").isNull()),
        ("unknown_kind", ~F.col("_v_kind").isin(*EVENT_KINDS)),
        *[
            (f"bad_field:window.{n}", has_window & ~_accepted(n, rule, "_w"))
            for n, rule in _WINDOW_MEMBERS.items()
        ],
    ]
    snapshot = F.struct(*[F.col(f"_wv_{f.name}").alias(f.name) for f in WINDOW_SNAPSHOT.fields])
    values = {
        name: F.col(f"_v_{name}").alias(name)
        for name in _EVENT_MEMBERS
        if name not in ("occurred_at", "window")
    }
    values["occurred_at"] = F.col("occurred_at")
    values["window"] = F.when(has_window, snapshot).alias("window")
    reason = F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in failures])
    return timed.select(
        *lines.columns, *[values[name] for name in PAYLOAD.names], reason.alias("reason")
    )


def valid_events(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("reason").isNull()).drop("reason", "payload")


def quarantined(decoded: DataFrame) -> DataFrame:
    """Rejected payloads with the first reason; the stream goes on without them."""
    ids = [name for name in ("event_id",) if name in decoded.columns]
    return decoded.where(F.col("reason").isNotNull()).select(*ids, "payload", "reason")


def wire_json() -> Column:
    """A payload row as JSON, nulls written out."""
    return F.to_json(
        F.struct(
            instant_text(F.col("occurred_at")).alias("occurred_at"),
            *[F.col(name) for name in PAYLOAD.names if name != "occurred_at"],
        ),
        {"ignoreNullFields": "false"},
    )


def to_wire(payloads: DataFrame, prefix: str = "") -> DataFrame:
    """Events as lines a line source can read: prefix and JSON."""
    return payloads.select(F.concat(F.lit(prefix), wire_json()).alias("value"))
