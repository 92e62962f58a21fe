"""Instants: wire text, display text, query parameters."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a date-time with seconds and an explicit offset.
_WIRE_INSTANT = (
    r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:?\d{2})$"
)


def parse_instant(text: Column) -> Column:
    """Wire text to an instant; NULL when it is not a date-time with an offset."""
    return F.when(text.rlike(_WIRE_INSTANT), F.upper(text).try_cast("timestamp"))


def instant_text(instant: Column) -> Column:
    """UTC wire text with no, three or six fraction digits, as few as are exact."""
    micros = F.pmod(F.unix_micros(instant), F.lit(1_000_000))
    shown = lambda pattern: F.date_format(instant, pattern)
    return (
        F.when(micros == 0, shown("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(micros % 1000 == 0, shown("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .otherwise(shown("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    )


def compact_text(instant: Column, zone: str = "UTC", empty: str = "") -> Column:
    """`2026.4.18 09:05:00` in the viewer's zone."""
    local = F.from_utc_timestamp(instant, zone)
    return F.coalesce(F.date_format(local, "y.M.d HH:mm:ss"), F.lit(empty))


def as_utc(moment: datetime | str) -> datetime:
    """A query parameter as an aware UTC datetime; naive values are taken as UTC."""
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment)
    if moment.tzinfo is None:
        return moment.replace(tzinfo=timezone.utc)
    return moment.astimezone(timezone.utc)
