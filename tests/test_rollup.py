"""Day partials: ranges merged from them equal a scan of the log."""

from datetime import date, timedelta

import pytest

from conftest import arrivals_of, at, event, window
from pyspark.sql import functions as F
from tideglass.operators import rollup
from tideglass.operators.summary import SummaryQuery, activity_summary
from tideglass.store import TimelineStore

KINDS = ("key_press", "key_release", "button_press", "wheel")


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    first = at("2026-04-17T22:00:00")
    events = []
    for i in range(240):
        seen = window(title=f"t{i % 23}", app_name=f"app {i % 13}") if i % 7 else None
        events.append(event(f"v{i}", seen, kind=KINDS[i % 4], occurred_at=first + timedelta(minutes=47 * i)))
    # The first and the last moment of a day.
    events.append(event("first", window(title="t1", app_name="app 1"), occurred_at=at("2026-04-20T00:00:00")))
    events.append(event("last", window(title="only once"), occurred_at=at("2026-04-20T23:59:59.999999")))
    return TimelineStore(spark, str(tmp_path_factory.mktemp("days"))).ingest(arrivals_of(spark, events))


RANGES = [
    (None, None),
    ("2026-04-20T00:00:00Z", "2026-04-20T23:59:59.999999Z"),
    ("2026-04-20T00:00:00Z", "2026-04-20T23:59:59Z"),
    ("2026-04-20T00:00:00.000001Z", None),
    ("2026-04-18T05:00:00Z", "2026-04-18T09:00:00Z"),
    ("2026-04-18T05:00:00+08:00", "2026-04-22T09:00:00+08:00"),
    (None, "2026-04-19T12:00:00Z"),
    ("2026-04-21T12:00:00Z", "2026-04-19T12:00:00Z"),
    ("2030-01-01T00:00:00Z", None),
]


@pytest.mark.parametrize("start, end", RANGES)
def test_ranges_equal_the_scan(log, start, end):
    query = SummaryQuery(start, end)
    partials = rollup.day_partials(log.log, log.windows)
    # Nothing of the log but the cut days is needed.
    cut = rollup.split_range(query)[2]
    edges = log.log.where(F.to_date("occurred_at").isin(cut)) if cut else log.log.limit(0)
    found = rollup.summary_from_days(partials, edges, log.windows, query)
    wanted = activity_summary(log.log, log.windows, query)
    assert found.columns == wanted.columns
    assert found.first() == wanted.first()


def test_batches_that_share_days_and_windows_merge(log):
    parts = [rollup.day_partials(log.log.where(F.col("event_id") % 3 == k), log.windows) for k in range(3)]
    merged = parts[0].merged(parts[1]).merged(parts[2])
    whole = rollup.day_partials(log.log, log.windows)
    for name in ("apps", "seen"):
        left, right = (sorted(map(repr, getattr(p, name).collect())) for p in (merged, whole))
        assert left == right


def test_split_range():
    day = date(2026, 4, 20)
    assert rollup.split_range(SummaryQuery()) == (None, None, [])
    assert rollup.split_range(SummaryQuery("2026-04-20T00:00:00Z", "2026-04-20T23:59:59.999999Z")) == (day, day, [])
    assert rollup.split_range(SummaryQuery("2026-04-20T00:00:00Z", "2026-04-20T10:00:00Z")) == (day, day - timedelta(1), [day])
    one = rollup.split_range(SummaryQuery("2026-04-20T01:00:00Z", "2026-04-20T10:00:00Z"))
    assert one == (day + timedelta(1), day - timedelta(1), [day])


def test_empty_log(spark, log):
    empty = log.log.limit(0)
    found = rollup.summary_from_days(rollup.day_partials(empty, log.windows), empty, log.windows)
    assert found.first() == activity_summary(empty, log.windows).first()
