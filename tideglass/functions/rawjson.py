"""Raw JSON texts kept beside an event, and JSON validity."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tideglass.functions.times import instant_text
from tideglass.session import prepare

_KEEP_NULLS = {"ignoreNullFields": "false"}


def raw_event_json(
    kind: Column,
    value: Column,
    delta_x: Column,
    delta_y: Column,
    key_name: Column,
    occurred_at: Column,
    collector_name: Column,
    collector_version: Column,
) -> Column:
    """The eight-field JSON of a captured event, nulls written out."""
    return F.to_json(
        F.struct(
            collector_name.alias("collector_name"),
            collector_version.alias("collector_version"),
            delta_x.alias("delta_x"),
            delta_y.alias("delta_y"),
            key_name.alias("key_name"),
            kind.alias("kind"),
            instant_text(occurred_at).alias("occurred_at"),
            value.alias("value"),
        ),
        _KEEP_NULLS,
    )


def raw_window_json(window: Column) -> Column:
    """Nested JSON of a captured window; `{}` when there is none."""
    body = F.to_json(
        F.struct(
            window["app_name"].alias("app_name"),
            F.struct(
                window["position"]["x"].alias("x"), window["position"]["y"].alias("y")
            ).alias("position"),
            window["process_id"].alias("process_id"),
            window["process_path"].alias("process_path"),
            F.struct(
                window["size"]["height"].alias("height"), window["size"]["width"].alias("width")
            ).alias("size"),
            window["title"].alias("title"),
        ),
        _KEEP_NULLS,
    )
    return F.when(window.isNull(), F.lit("{}")).otherwise(body)


def _tag(text: Column) -> Column:
    return F.hex(F.xxhash64(text))


def tagged_json(text: Column) -> Column:
    """A variant array of the text's JSON value and a tag of the text, or NULL.

    `try_parse_json` stops after the first value and ignores what follows. As the first
    item of an array whose second item is a tag of the text, a truncated, doubled or
    trailed value either fails or leaves the tag out of place. Of a member given twice the
    last value stays, as JSON readers have it. Not taken, and so NULL, are texts beyond the
    limits of Spark's parser: 999 levels, 1,000 digits of a number, 50,000 characters of a
    member's name.
    """
    session = SparkSession.getActiveSession()
    if session is not None:
        prepare(session)
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), _tag(text), F.lit('"]')))


def tagged_value(pair: Column, text: Column) -> Column:
    """The value of `tagged_json`, NULL if the text is not exactly one JSON value."""
    whole = F.try_variant_get(pair, "$[1]", "string") == _tag(text)
    return F.when(whole, F.try_variant_get(pair, "$[0]", "variant"))


def repeated_members(text: Column, names: Iterable[str]) -> Column:
    """Those of `names` that the JSON object in `text` has more than once, in their order.

    Member names are compared as they read, whatever escapes they are written with; members
    of inner objects do not count. NULL for texts that are not an object.
    """
    keys = F.json_object_keys(text)
    listed = F.array(*[F.lit(name) for name in names])
    twice = F.filter(listed, lambda name: F.size(F.filter(keys, lambda key: key == name)) > 1)
    # Nearly all objects repeat nothing: one look at the whole list tells.
    whole = F.size(F.array_distinct(keys)) == F.size(keys)
    return F.when(keys.isNull(), F.lit(None)).when(whole, F.array().cast("array<string>")).otherwise(twice)


def is_valid_json(text: Column) -> Column:
    """True for one whole JSON value; false for anything else, NULL and '' included."""
    return tagged_value(tagged_json(text), text).isNotNull()
