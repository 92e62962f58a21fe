"""The data cases every implementation of the timeline must meet."""

from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from conftest import arrivals_of, at, event, window
from tideglass.functions.hashing import context_hash
from tideglass.operators.timeline import EventQuery, WindowQuery
from tideglass.store import TimelineStore


def hash_of(spark, seen):
    names = ("app_name", "process_id", "process_path", "title")
    row = spark.createDataFrame(
        [[None if seen[n] is None else str(seen[n]) for n in names]],
        "app_name string, process_id string, process_path string, title string",
    )
    return row.select(context_hash(*[F.col(n) for n in names])).first()[0]


def test_hash_ignores_geometry(spark):
    assert hash_of(spark, window()) == hash_of(spark, window(x=100.0, width=800.0))
    assert hash_of(spark, window()) != hash_of(spark, window("cargo run"))


@pytest.mark.parametrize(
    "identity, expected",
    [
        (window(), "v1-07d4c0ede7ea0a34"),
        (window("", app_name="应用", process_id=None, process_path=None), "v1-fd6c658405314a0d"),
        (window("é" * 50, app_name="x", process_id=0, process_path=""), "v1-759ee8b5e23ff4fb"),
    ],
)
def test_hash_vectors(spark, identity, expected):
    assert hash_of(spark, identity) == expected


def plain_hash(parts):
    state = 0xCBF29CE484222325
    for part in parts:
        data = part.encode()
        for byte in len(data).to_bytes(8, "little") + data:
            state = (state ^ byte) * 0x100000001B3 % 2**64
    return f"v1-{state:016x}"


def test_hash_against_plain_integers(spark):
    for app, pid, path, title in [
        ("", "", "", ""),
        ("a\n\x00b", "18446744073709551615", "/ü", "日本語 🙂" * 40),
        ("x" * 300, "1", " ", "\\'\""),
    ]:
        seen = window(title, app_name=app, process_id=pid, process_path=path)
        assert hash_of(spark, seen) == plain_hash([app, pid, path, title])


def test_same_identity_is_one_window(ingest):
    s = ingest(event("KeyA", window()), event("KeyB", window(x=24.0)))
    rows = s.events.orderBy("event_id").collect()
    assert rows[0]["window_id"] == rows[1]["window_id"] == 1
    found = s.window(1).first()
    assert (found["event_count"], found["x"]) == (2, 24.0)
    assert s.windows.count() == 1


def test_list_keeps_events_without_window(ingest):
    s = ingest(event("KeyA", window()), event("KeyB"))
    page = s.list_events(EventQuery(kind="key_press", size=10))
    rows = page.rows.collect()
    assert (page.page, page.total, page.pages, len(rows)) == (1, 2, 1, 2)
    assert rows[0]["event"]["collector_name"] == "listener"
    assert rows[0]["event"]["collector_version"] == "0.0.1-test"
    assert [r["window"] is None for r in rows] == [True, False]


def test_page_and_cursor(ingest):
    s = ingest(*[event(v, window()) for v in ("KeyA", "KeyB", "KeyC")])
    by_id = {"size": 1, "sort_by": "event_id", "sort_direction": "asc"}
    page = s.list_events(EventQuery(page=2, **by_id))
    assert (page.page, page.total, page.pages) == (2, 3, 3)
    assert [r["event"]["event_value"] for r in page.rows.collect()] == ["KeyB"]
    page = s.list_events(EventQuery(page=1, cursor=2, **by_id))
    assert (page.page, page.total, page.pages) == (3, 3, 3)
    assert [r["event"]["event_value"] for r in page.rows.collect()] == ["KeyC"]


def test_windows_by_hash(spark, ingest):
    s = ingest(event("KeyA", window()))
    wanted = hash_of(spark, window())
    page = s.list_windows(WindowQuery(context_hash=wanted))
    assert (page.page, page.total, page.pages) == (1, 1, 1)
    assert page.rows.first()["context_hash"] == wanted
    assert s.window_by_hash(wanted).count() == 1
    assert s.window_by_hash("v1-0").isEmpty()


def test_search(ingest):
    s = ingest(event("KeyA", window()), event("KeyB", window("docs", app_name="Safari")))
    page = s.list_events(EventQuery(search="term", size=10))
    assert page.total == 1
    assert page.rows.first()["window"]["app_name"] == "Terminal"
    page = s.list_windows(WindowQuery(search="fari"))
    assert page.total == 1
    assert page.rows.first()["app_name"] == "Safari"


def test_windows_page(ingest):
    s = ingest(event("KeyA", window()), event("KeyB", window("cargo run")))
    page = s.list_windows(
        WindowQuery(page=2, size=1, sort_by="window_id", sort_direction="asc")
    )
    assert (page.page, page.total, page.pages) == (2, 2, 2)
    assert [r["title"] for r in page.rows.collect()] == ["cargo run"]


def test_collector_defaults(ingest):
    s = ingest(event("KeyA", collector_name=None, collector_version=None))
    row = s.events.first()
    assert (row["collector_name"], row["collector_version"]) == ("listener", "unknown")
    assert row["created_at"] is not None


def test_rows_that_break_a_constraint_are_quarantined(spark, tmp_path):
    rows = arrivals_of(
        spark,
        [
            event("KeyA"),
            event(None),
            event("KeyA", occurred_at=None),
            event("KeyA", kind="key_hold"),
            event("KeyA", window(None)),
            event("KeyA", window(process_id=Decimal(-1))),
            event("KeyB", window(process_id=Decimal(2**64))),
        ],
    )
    store = TimelineStore(spark, str(tmp_path))
    s = store.ingest(rows)
    assert [r["event_id"] for r in s.events.collect()] == [1]
    assert s.windows.isEmpty()
    found = store.quarantine().orderBy("event_id").collect()
    assert [r["reason"] for r in found] == [
        "missing:value", "missing:occurred_at", "unknown_kind", "missing:window.title",
        "out_of_range:window.process_id", "out_of_range:window.process_id",
    ]
    assert '"kind":"key_hold"' in found[2]["payload"]


def test_empty_store(spark, tmp_path):
    s = TimelineStore(spark, str(tmp_path / "none")).snapshot()
    page = s.list_events()
    assert (page.page, page.total, page.pages, page.rows.count()) == (1, 0, 0, 0)
    assert s.list_windows().total == 0
    assert s.event(1).isEmpty() and s.window(1).isEmpty()
    assert s.last_event_at().first()[0] is None
    row = s.summary().first()
    assert (row["total_events"], row["active_windows"], row["top_apps"]) == (0, 0, [])


def test_lookups_and_sql(ingest):
    s = ingest(event("KeyA", window()), event("KeyB"))
    assert s.event(2).first()["event_value"] == "KeyB"
    assert s.event(3).isEmpty()
    text = "SELECT count(*) FROM input_events WHERE event_value = :v AND window_id IS NULL"
    assert s.sql(text, {"v": "KeyB"}).first()[0] == 1
    with pytest.raises(AnalysisException):
        s.sql("SELECT nothing FROM input_events")


def test_unknown_parameters_are_refused(ingest):
    s = ingest(event("KeyA"))
    for query in (
        EventQuery(kind="key_hold"),
        EventQuery(sort_by="window"),
        EventQuery(sort_direction="up"),
    ):
        with pytest.raises(ValueError):
            s.list_events(query)
    assert at().tzinfo is not None
