"""Line source: strict decoding, quarantine, arrival order, streams."""

import json
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from conftest import event, window
from tideglass.functions.rawjson import is_valid_json, repeated_members
from tideglass.sources.lines import (
    decode_events,
    event_lines,
    number_lines,
    quarantined,
    read_lines,
    to_wire,
    valid_events,
)
from tideglass.store import TimelineStore
from tideglass.streaming.pipeline import stream_lines
from tideglass.streaming.running import running_result, stream_dimension, stream_summary

GOOD = {
    "occurred_at": "2026-04-18T00:00:00Z", "kind": "key_press", "value": "KeyA",
    "delta_x": None, "delta_y": None,
    "window": {
        "app_name": "Terminal", "process_path": None, "process_id": 42, "title": "t",
        "x": 1, "y": 2.5, "width": 3e2, "height": None,
    },
    "raw_event": None, "raw_window": "{}", "collector_name": "listener", "collector_version": "1",
}


def changed(**changes):
    return json.dumps({**GOOD, **changes})


def without(name):
    return json.dumps({k: v for k, v in GOOD.items() if k != name})


def in_window(**changes):
    return changed(window={**GOOD["window"], **changes})


def raw(old, new):
    text = json.dumps(GOOD)
    assert old in text
    return text.replace(old, new)


CASES = [
    (json.dumps(GOOD), None),
    (without("window"), None),
    (without("delta_x"), None),
    (changed(window=None, extra={"a": [1]}), None),
    (changed(delta_x=3), None),
    (in_window(process_id=2**64 - 1), None),
    (in_window(process_id=None), None),
    (in_window(app_name="", title=""), None),
    (json.dumps(GOOD)[:-7], "not_json"),
    (json.dumps(GOOD) + " {}", "not_json"),
    (json.dumps(GOOD) + "]", "not_json"),
    (json.dumps(GOOD) + "," + json.dumps(GOOD), "not_json"),
    ("hello", "not_json"),
    ("[1]", "not_an_object"),
    ("7", "not_an_object"),
    (raw('"kind": "key_press"', '"kind": "key_press", "kind": "wheel"'), "not_json"),
    (raw('"kind": "key_press"', r'"kind": "key_press", "k\u0069nd": "wheel"'), "not_json"),
    (raw('"title": "t"', '"title": "t", "title": "u"'), "not_json"),
    (raw('"delta_x": null', '"delta_x": null, "delta_x": null'), "not_json"),
    (raw('"window": {', '"window": null, "window": {'), "not_json"),
    (raw('"kind"', '"extra": 1, "extra": {"kind": 1, "kind": 2}, "kind"'), None),
    (raw('"title"', '"zoom": [], "zoom": {"title": 1, "title": 2}, "title"'), None),
    (raw('"kind"', '"extra": ' + "[" * 900 + "]" * 900 + ', "kind"'), None),
    (raw('"kind"', '"extra": ' + "[" * 1200 + "]" * 1200 + ', "kind"'), "not_json"),
    (changed(value=5), "bad_field:value"),
    (changed(value=None), "bad_field:value"),
    (without("value"), "bad_field:value"),
    (without("collector_version"), "bad_field:collector_version"),
    (changed(collector_name=True), "bad_field:collector_name"),
    (changed(delta_x="1"), "bad_field:delta_x"),
    (changed(raw_event={}), "bad_field:raw_event"),
    (changed(window="w"), "bad_field:window"),
    (changed(window=[]), "bad_field:window"),
    (changed(kind="key_hold"), "unknown_kind"),
    (changed(occurred_at="2026-04-18T00:00:00"), "bad_field:occurred_at"),
    (changed(occurred_at="2026-04-18"), "bad_field:occurred_at"),
    (changed(occurred_at=1), "bad_field:occurred_at"),
    (changed(window={"app_name": "a"}), "bad_field:window.title"),
    (in_window(title=1), "bad_field:window.title"),
    (in_window(process_id=-1), "bad_field:window.process_id"),
    (in_window(process_id=2**64), "bad_field:window.process_id"),
    (in_window(process_id=1.5), "bad_field:window.process_id"),
    (in_window(process_id=42.0), "bad_field:window.process_id"),
    (in_window(process_id="42"), "bad_field:window.process_id"),
    (in_window(x="0"), "bad_field:window.x"),
]


def test_decoding_is_strict(spark):
    lines = spark.createDataFrame(list(enumerate(t for t, _ in CASES)), "i int, payload string")
    decoded = decode_events(lines)
    found = [r["reason"] for r in decoded.orderBy("i").select("i", "reason").collect()]
    assert list(zip([t for t, _ in CASES], found)) == CASES
    good = valid_events(decoded).orderBy("i").collect()
    assert len(good) == 11
    assert good[0]["window"].asDict() == {
        "app_name": "Terminal", "process_path": None, "process_id": 42, "title": "t",
        "x": 1.0, "y": 2.5, "width": 300.0, "height": None,
    }
    assert good[1]["window"] is None and good[4]["delta_x"] == 3.0
    assert good[5]["window"]["process_id"] == 2**64 - 1
    assert quarantined(decoded).count() == len(CASES) - 11


def test_repeated_members_are_named(spark):
    texts = ['{"a":1}', '{"a":1,"b":2,"a":3}', r'{"b":1,"\u0062":2,"c":{"a":1,"a":2}}', '{"x":1,"x":2}', "[1]", "7", "{", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = rows.select("i", repeated_members(F.col("t"), ["a", "b"]).alias("r"), is_valid_json(F.col("t")).alias("v"))
    listed = [(r["r"], r["v"]) for r in found.orderBy("i").collect()]
    assert listed == [([], True), (["a"], True), (["b"], True), ([], True), (None, True), (None, True), (None, False), (None, False)]


def test_lines_are_trimmed_and_filtered_by_prefix(spark):
    rows = ["  @e {}  ", "　@e x\t", "", "   ", "log: @e {}", "@f {}", "@e"]
    lines = spark.createDataFrame([(r,) for r in rows], "value string")
    kept = [r["payload"] for r in event_lines(lines, "@e").collect()]
    assert kept == [" {}", " x", ""]
    assert event_lines(lines).count() == 5


def write_feed(folder, name, texts, when):
    path = folder / name
    path.write_text("\n".join(texts) + "\n", encoding="utf-8")
    os.utime(path, (when, when))


def test_numbers_follow_file_time_and_place(spark, tmp_path):
    # Names and sizes run against the times; large files are cut into splits.
    write_feed(tmp_path, "c.txt", [f"first {i}" for i in range(2000)], 1000)
    write_feed(tmp_path, "b.txt", ["second 0", "", "second 1"], 2000)
    write_feed(tmp_path, "a.txt", [f"third {i}" for i in range(500)], 3000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = event_lines(read_lines(spark, str(tmp_path)))
        rows = number_lines(lines, after=10).orderBy("event_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    wanted = [f"first {i}" for i in range(2000)] + ["second 0", "second 1"]
    wanted += [f"third {i}" for i in range(500)]
    assert [r["payload"] for r in rows] == wanted
    assert [r["event_id"] for r in rows] == list(range(11, 11 + len(wanted)))


@pytest.fixture
def feed(tmp_path):
    """Five files of lines; every seventh line is damaged, some belong to other programs."""
    folder = tmp_path / "feed"
    folder.mkdir()
    texts = []
    for i in range(50):
        text = "@e" + json.dumps(
            {
                **GOOD, "value": f"v{i}",
                "kind": "wheel" if i % 5 == 0 else "key_press",
                "window": None if i % 4 == 0 else {**GOOD["window"], "title": f"t{i % 3}", "x": i},
            }
        )
        texts.append(text[:-3] if i % 7 == 0 else text)
    for number in range(5):
        part = texts[number * 10 : number * 10 + 10] + ["starting up", ""]
        write_feed(folder, f"part{number}.txt", part, 1_000_000 + number)
    return folder


def plain_rows(df, *drop):
    columns = sorted(set(df.columns) - {"created_at", *drop})
    return sorted(map(repr, df.select(columns).collect()))


def test_stream_equals_batch(spark, tmp_path, feed):
    batch = TimelineStore(spark, str(tmp_path / "batch"))
    once = batch.ingest_lines(read_lines(spark, str(feed)), "@e")
    assert once.events.count() == 42
    assert batch.quarantine().count() == 8
    assert {r["reason"] for r in batch.quarantine().collect()} == {"not_json"}

    store = TimelineStore(spark, str(tmp_path / "stream"))
    lines = (
        spark.readStream.format("text").option("maxFilesPerTrigger", 2).load(str(feed))
    ).select(
        "value",
        "_metadata.file_modification_time",
        "_metadata.file_path",
        "_metadata.file_block_start",
    ).toDF("value", "file_time", "file_path", "file_start")
    stream_lines(store, lines, str(tmp_path / "check"), "feed", "@e").awaitTermination()
    s = store.snapshot()
    assert s.version == 3
    assert plain_rows(s.events, "event_id") == plain_rows(once.events, "event_id")
    assert plain_rows(s.windows) == plain_rows(once.windows)
    assert store.quarantine().count() == 8

    # A lost checkpoint replays the files, and a new one with them: each line counts once.
    text = "@e" + json.dumps({**GOOD, "value": "late"})
    write_feed(feed, "part9.txt", [text, text], 1_000_009)
    stream_lines(store, lines, str(tmp_path / "again"), "feed", "@e").awaitTermination()
    s = store.snapshot()
    assert s.events.count() == once.events.count() + 2 and store.quarantine().count() == 8
    assert s.events.where("event_value = 'late'").count() == 2
    assert s.events.select("event_id").distinct().count() == s.events.count()

    # One name for a second feed keeps both.
    other = tmp_path / "other"
    other.mkdir()
    write_feed(other, "part0.txt", [text], 1_000_000)
    second = read_lines(spark, str(other), streaming=True)
    stream_lines(store, second, str(tmp_path / "second"), "feed", "@e").awaitTermination()
    assert store.snapshot().events.where("event_value = 'late'").count() == 3

    # Without file columns nobody can tell: no quiet return.
    bare = lines.select("value", F.lit(0).alias("partition"), F.lit(1).alias("offset"))
    started = stream_lines(store, bare, str(tmp_path / "bare"), "feed", "@e", order_by=["partition", "offset"])
    with pytest.raises(StreamingQueryException, match="read before"):
        started.awaitTermination()


def test_lines_of_other_sources_are_numbered_by_their_columns(spark):
    rows = [(f"v{p}{o}", p, o) for o in (2, 0, 1) for p in (1, 0)]
    lines = event_lines(spark.createDataFrame(rows, "value string, partition int, offset int"))
    found = number_lines(lines.repartition(3), 5, ["partition", "offset"]).orderBy("event_id").collect()
    assert [(r["event_id"], r["payload"]) for r in found] == [(6 + i, t) for i, t in enumerate(["v00", "v01", "v02", "v10", "v11", "v12"])]
    with pytest.raises(ValueError, match="name the columns"):
        number_lines(lines)


def test_torn_splits_are_refused(spark, tmp_path):
    write_feed(tmp_path, "a.txt", [f"line {i}" for i in range(500)], 1000)
    with pytest.raises(ValueError, match="dealt anew"):
        number_lines(event_lines(read_lines(spark, str(tmp_path))).repartition(4))


def test_running_results_equal_batch(spark, tmp_path, feed):
    s = TimelineStore(spark, str(tmp_path / "batch")).ingest_lines(
        read_lines(spark, str(feed)), "@e"
    )
    source = tmp_path / "payloads"
    payloads = s.events.join(
        s.windows.select("window_id", "app_name", "process_path", "process_id", "title", "x", "y",
                         "width", "height"),
        "window_id", "left",
    ).selectExpr(
        "event_id", "occurred_at", "event_kind AS kind",
        "CASE WHEN window_id IS NOT NULL THEN struct(app_name, process_path, process_id, title, "
        "x, y, width, height) END AS window",
    )
    payloads.repartition(4).write.parquet(str(source))
    stream = (
        spark.readStream.schema(payloads.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    )
    stream_dimension(stream, str(tmp_path / "d"), str(tmp_path / "dc")).awaitTermination()
    kept = running_result(spark, str(tmp_path / "d"))
    assert plain_rows(kept.select(s.windows.columns)) == plain_rows(s.windows)
    stream_summary(stream, str(tmp_path / "s"), str(tmp_path / "sc")).awaitTermination()
    assert running_result(spark, str(tmp_path / "s")).collect() == s.summary().collect()


def test_running_results_before_the_first_trigger(spark, tmp_path):
    schema = "event_id bigint, occurred_at timestamp, kind string, window struct<app_name: string, process_path: string, process_id: decimal(20,0), title: string, x: double, y: double, width: double, height: double>"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    started = stream_summary(stream, str(tmp_path / "s"), str(tmp_path / "sc"))
    first = running_result(spark, str(tmp_path / "s")).first()
    assert (first["total_events"], first["active_windows"], first["top_apps"]) == (0, 0, [])
    started.awaitTermination()
    stream_dimension(stream, str(tmp_path / "d"), str(tmp_path / "dc")).awaitTermination()
    assert running_result(spark, str(tmp_path / "d")).collect() == []


def test_wire_round_trip(spark, tmp_path):
    from conftest import arrivals_of

    rows = arrivals_of(
        spark,
        [event('a"\\\n', window("é\t"), delta_x=0.1), event("b", None, raw_event=None)],
    ).drop("event_id")
    back = valid_events(decode_events(event_lines(to_wire(rows, "@e "), "@e ")))
    assert back.collect() == rows.collect()
