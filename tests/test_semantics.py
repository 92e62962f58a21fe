"""Cases that decide between a right and a nearly right implementation."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import at, event, window
from tideglass.functions.text import (
    contains_text,
    normalise_search,
    number_text,
    round_half_up,
    trim_text,
)
from tideglass.functions.times import compact_text, instant_text, parse_instant
from tideglass.operators import timeline, views
from tideglass.operators.summary import SummaryQuery, top_apps
from tideglass.operators.timeline import EventQuery, WindowQuery, resolve_paging


@pytest.mark.parametrize(
    "asked, resolved",
    [
        ((None, None, None), (1, 100, 0)),
        ((2, 25, None), (2, 25, 25)),
        ((0, 0, None), (1, 1, 0)),
        ((-5, -1, None), (1, 1, 0)),
        ((1, 5000, None), (1, 1000, 0)),
        ((9, 10, 25), (3, 10, 25)),
        ((9, 10, -4), (1, 10, 0)),
        ((10, 100, None), (10, 100, 900)),
    ],
)
def test_paging(asked, resolved):
    assert resolve_paging(*asked) == resolved


def column(spark, values, dtype):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")


def results(df, expression):
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_rounding_goes_up_on_halves(spark):
    df = column(spark, [-1.5, -0.5, 0.5, 1.5, 2.4, None], "double")
    assert results(df, round_half_up(F.col("v"))) == [-1, 0, 1, 2, 2, None]


def test_number_text(spark):
    wanted = {
        -1.0: "-1", 0.0: "0", 0.25: "0.25", 12345678.5: "12345678.5", 0.0001: "0.0001", 1e-7: "1e-7",
        -2.5: "-2.5", 1e17: "100000000000000000", 0.012345678901234568: "0.012345678901234568",
        0.00012345678901234567: "0.00012345678901234567", 123456789012345680000.0: "123456789012345680000",
        1e20: "100000000000000000000", 1e21: "1e+21", -1e22: "-1e+22", 1.5e300: "1.5e+300", 5e-324: "5e-324",
        1e-6: "0.000001", 2e-3: "0.002", 2.0e23: "2e+23", 1.7976931348623157e308: "1.7976931348623157e+308",
        0.1 + 0.2: "0.30000000000000004", 9007199254740993.0: "9007199254740992", float("inf"): "Infinity",
        float("-inf"): "-Infinity", 4.35: "4.35", 2.2250738585072014e-308: "2.2250738585072014e-308",
    }
    df = column(spark, [*wanted, -0.0, float("nan"), None], "double")
    assert results(df, number_text(F.col("v"))) == [*wanted.values(), "0", "NaN", None]


def test_trim_takes_unicode_space(spark):
    df = column(spark, ["　 a b\t\n", "\u2003", "x\u200b", None], "string")
    assert results(df, trim_text(F.col("v"))) == ["a b", "", "x\u200b", None]
    assert normalise_search("　 \n") is None
    assert normalise_search(None) is None
    assert normalise_search(" a ") == "a"


@pytest.mark.parametrize(
    "search, hits",
    [
        ("A_B", ["a_b", "axb", "a\\b c"]),
        ("a%c", ["a-c", "a\\b c"]),
        ("\\", ["a\\b c"]),
        ("\\b", ["a\\b c"]),
        ("a\\_b", []),
        ("É", ["é"]),
    ],
)
def test_search_pattern(spark, search, hits):
    df = column(spark, ["a_b", "axb", "a-c", "a\\b c", "é", None], "string")
    found = [r["v"] for r in df.where(contains_text(F.col("v"), search)).collect()]
    assert sorted(found) == sorted(hits)


def test_instants(spark):
    texts = [
        "2026-04-18T00:00:00Z", "2026-04-18T08:00:00.5+08:00", "2026-04-18t00:00:00.123456789z",
        "2026-04-18 00:00:00-0130", "2026-04-18T00:00:00", "2026-04-18", "2026-13-18T00:00:00Z", "x",
    ]
    df = column(spark, texts, "string").withColumn("t", parse_instant(F.col("v")))
    assert results(df, instant_text(F.col("t"))) == [
        "2026-04-18T00:00:00Z", "2026-04-18T00:00:00.500Z", "2026-04-18T00:00:00.123456Z",
        "2026-04-18T01:30:00Z", None, None, None, None,
    ]
    shown = results(df, compact_text(F.col("t"), "Asia/Shanghai", "-"))
    assert shown[:2] == ["2026.4.18 08:00:00", "2026.4.18 08:00:00"]
    assert shown[-1] == "-"


def ids(page):
    return [r["event"]["event_id"] for r in page.rows.collect()]


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    """Six events: out of order, two without window, equal times, an app called Unknown."""
    from conftest import arrivals_of
    from tideglass.store import TimelineStore

    later = at() + timedelta(days=3)
    events = [
        event("b", window(), occurred_at=later),
        event("", window(x=None, y=None), kind="wheel", delta_x=0.5),
        event("a", None),
        event("c", window("t", app_name="Unknown")),
        event("", None, kind="wheel", occurred_at=later, delta_x=-1.0, delta_y=2.0),
        event("a", window("t", app_name="apps")),
    ]
    store = TimelineStore(spark, str(tmp_path_factory.mktemp("mixed")))
    return store.ingest(arrivals_of(spark, events))


def test_sorts_put_missing_app_last(mixed):
    assert ids(mixed.list_events(EventQuery(sort_by="app_name", sort_direction="asc"))) == [1, 2, 4, 6, 3, 5]
    assert ids(mixed.list_events(EventQuery(sort_by="app_name"))) == [6, 4, 2, 1, 5, 3]


def test_sorts_break_ties_by_id_in_the_same_direction(mixed):
    assert ids(mixed.list_events()) == [5, 1, 6, 4, 3, 2]
    assert ids(mixed.list_events(EventQuery(sort_direction="asc"))) == [2, 3, 4, 6, 1, 5]
    assert ids(mixed.list_events(EventQuery(sort_by="kind", sort_direction="asc"))) == [1, 3, 4, 6, 2, 5]
    assert ids(mixed.list_events(EventQuery(sort_by="value"))) == [4, 1, 6, 3, 5, 2]


@pytest.mark.parametrize("top_k, direct", [(10_000, 10_000_000), (10_000, 0), (0, 0)])
def test_every_page_of_every_sort(mixed, monkeypatch, top_k, direct):
    """Pages by plain top-k, by thinned top-k and by numbered rows all cut the sorted list."""
    for sort_by in timeline.EVENT_SORTS:
        whole = ids(mixed.list_events(EventQuery(sort_by=sort_by)))
        monkeypatch.setattr(timeline, "TOP_K_ROWS", top_k)
        monkeypatch.setattr(timeline, "DIRECT_ROWS", direct)
        for cursor in (1, 3):
            page = mixed.list_events(EventQuery(sort_by=sort_by, cursor=cursor, size=2))
            assert ids(page) == whole[cursor : cursor + 2]
            assert [r["pos"] for r in page.rows.collect()] == [cursor, cursor + 1]
        monkeypatch.undo()


def test_thinned_top_k_on_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(timeline, "DIRECT_ROWS", 0)
    monkeypatch.setattr(timeline, "LAST_STEP_ROWS", 300)
    df = spark.range(5000).selectExpr("xxhash64(id) % 40 AS v", "id AS event_id").repartition(9)
    order = timeline.sort_keys("v", "event_id", "desc")
    rows = timeline._page_of(df, ["v", "event_id"], order, True, 90, 30, 5000).collect()
    wanted = sorted(df.collect(), reverse=True)[90:120]
    assert rows == wanted


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("kind", ["text", "long", "time", "few", "heavy"])
def test_deep_pages_of_any_key(spark, monkeypatch, kind, descending):
    """Narrowed by quantiles down to a few rows: shared prefixes, NULs, NULLs, ties, extremes."""
    monkeypatch.setattr(timeline, "TOP_K_ROWS", 0)
    monkeypatch.setattr(timeline, "RANGE_ROWS", 12)
    rng = random.Random(f"{kind}{descending}")
    make = {
        "text": lambda: rng.choice(["", "a", "prefix shared by many ", "é", "a\0", "a\0\0", None]) + str(rng.randrange(40))
        if rng.random() < 0.8 else rng.choice(["", "a", "a\0", "a\0\0", "\0", None]),
        "long": lambda: rng.choice([None, -(2**60), 2**60, rng.randrange(-5, 5), rng.randrange(-(2**61), 2**61)]),
        "time": lambda: rng.choice([None, datetime(1960, 1, 1), datetime(2026, 1, 1, microsecond=rng.randrange(9))]),
        "few": lambda: rng.choice(["button_press", "button_release", "key_press", "key_release", "wheel"]),
        "heavy": lambda: rng.choice(["first"] * 60 + ["last"] * 60 + ["in between", "more"]),
    }[kind]

    def value():
        try:
            return make()
        except TypeError:  # a NULL with a number behind it
            return None

    ddl = {"long": "bigint", "time": "timestamp"}.get(kind, "string")
    rows = [(value(), i * 7) for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, f"v {ddl}, event_id bigint").repartition(4)
    order = timeline.sort_keys("v", "event_id", "desc" if descending else "asc")
    wanted = [tuple(r) for r in df.orderBy(*order).collect()]
    for offset, size in ((141, 30), (290, 30)):
        found = timeline._page_of(df, ["v", "event_id"], order, descending, offset, size, 300)
        assert [tuple(r) for r in found.orderBy(*order).collect()] == wanted[offset : offset + size]


def test_past_the_end_keeps_page_and_total(mixed):
    page = mixed.list_events(EventQuery(page=7, size=4))
    assert (page.page, page.total, page.pages, ids(page)) == (7, 6, 2, [])


def test_range_is_inclusive(mixed):
    later = at() + timedelta(days=3)
    assert mixed.list_events(EventQuery(start_at=at(), end_at=at())).total == 4
    assert mixed.list_events(EventQuery(start_at=later)).total == 2
    assert mixed.list_events(EventQuery(end_at=later)).total == 6
    assert mixed.list_events(EventQuery(start_at=later, end_at=at())).total == 0
    assert mixed.list_events(EventQuery(start_at="2026-04-18T08:00:00+08:00")).total == 6


def test_window_filters_drop_events_without_window(mixed):
    assert ids(mixed.list_events(EventQuery(search="unknown"))) == [4]
    assert ids(mixed.list_events(EventQuery(search="  "))) == [5, 1, 6, 4, 3, 2]
    assert ids(mixed.list_events(EventQuery(search="app"))) == [6]
    assert ids(mixed.list_events(EventQuery(app_name=" apps"))) == []
    assert mixed.list_windows(WindowQuery(app_name="Terminal")).total == 1


def test_last_arrival_wins_and_null_overwrites(mixed):
    terminal = mixed.windows.where("app_name = 'Terminal'").first()
    assert (terminal["x"], terminal["y"], terminal["width"]) == (None, None, 1280.0)
    assert terminal["first_seen_at"] < terminal["last_seen_at"]
    assert terminal["event_count"] == 2


def test_summary(mixed):
    row = mixed.summary().first()
    assert row["total_events"] == 6
    assert (row["key_events"], row["button_events"], row["wheel_events"]) == (4, 0, 2)
    assert row["active_windows"] == 3
    # The app called Unknown and the events without a window share one entry.
    assert [(a["app_name"], a["event_count"]) for a in row["top_apps"]] == [
        ("Unknown", 3), ("Terminal", 2), ("apps", 1),
    ]
    assert row["top_apps"][0]["share"] == 50.0
    empty = mixed.summary(SummaryQuery(start_at=at("2030-01-01T00:00:00"))).first()
    assert (empty["total_events"], empty["top_apps"]) == (0, [])


def test_top_apps_are_ten_with_share_of_all(ingest):
    events = [event("k", window("t", app_name=f"app{i:02d}")) for i in range(12)]
    s = ingest(*events, event("k", window("t", app_name="app11")))
    rows = top_apps(s.log, s.windows).orderBy("pos").collect()
    assert [r["app_name"] for r in rows] == ["app11"] + [f"app{i:02d}" for i in range(9)]
    assert rows[0]["share"] == 2 / 13 * 100.0
    assert [r["pos"] for r in rows] == list(range(1, 11))


def test_null_and_empty_path_are_one_window(ingest):
    s = ingest(
        event("a", window(process_path=None)),
        event("b", window(process_path="")),
        event("c", window(process_id=None)),
        event("d", window(process_id=Decimal(0))),
        event("e", window(process_id=Decimal(2**64 - 1))),
    )
    assert [r["window_id"] for r in s.events.orderBy("event_id").collect()] == [1, 1, 2, 3, 4]
    rows = s.windows.orderBy("window_id").collect()
    assert rows[0]["process_path"] is None and rows[0]["event_count"] == 2
    assert rows[3]["process_id"] == 2**64 - 1


def test_views(mixed):
    items = views.list_items(mixed.list_events(EventQuery(sort_by="event_id", sort_direction="asc")).rows)
    rows = items.orderBy("pos").collect()
    assert [r["value"] for r in rows] == [
        "b", "delta_x:0.5, delta_y:0", "a", "c", "delta_x:-1, delta_y:2", "a",
    ]
    assert (rows[2]["app_name"], rows[2]["window_title"]) == ("Unknown", "")
    assert len(views.recent_events(mixed.log, mixed.windows).columns) == 8
    detail = views.event_detail(mixed.log, mixed.windows, 1).first()
    assert detail["window"]["app_name"] == "Terminal"
    assert detail["raw_event_is_json"] and not detail["raw_window_is_json"]
    assert views.event_detail(mixed.log, mixed.windows, 3).first()["window"] is None
    assert views.event_detail(mixed.log, mixed.windows, 99).isEmpty()
    assert ids(views.window_events(mixed.log, mixed.windows, 1)) == [1, 2]
    shown = views.window_display(mixed.windows).orderBy("window_id").collect()
    assert [(r["size_text"], r["position_text"]) for r in shown][:2] == [
        ("1280 x 720", "-"), ("1280 x 720", "0, 0"),
    ]
