"""The set-based dimension against a row-by-row simulation of the upsert."""

import random
from datetime import timedelta
from decimal import Decimal

import pytest

from conftest import arrivals_of, at, event, window
from tideglass.operators import dimension as dim
from tideglass.schemas import WINDOW, WINDOW_STATE
from tideglass.session import materialise
from tideglass.store import SourceBatch, TimelineStore


def random_events(seed, n=120):
    draw = random.Random(seed)
    found = []
    for i in range(n):
        seen = None
        if draw.random() > 0.2:
            # One identity takes about a third of all events.
            hot = draw.random() < 0.4
            seen = window(
                "hot" if hot else f"t{draw.randrange(6)}",
                process_path=draw.choice([None, "", "/a"]),
                process_id=None if draw.random() < 0.2 else Decimal(draw.randrange(3)),
                x=None if draw.random() < 0.3 else float(i),
                height=float(draw.randrange(5)),
            )
        moment = at() + timedelta(seconds=draw.randrange(-5000, 5000))
        found.append(event(f"v{i}", seen, occurred_at=moment))
    return found


def simulate(events):
    """Insert one event after the other."""
    windows, links = {}, []
    for e in events:
        seen = e["window"]
        if seen is None:
            links.append(None)
            continue
        key = (
            seen["app_name"],
            "" if seen["process_id"] is None else str(seen["process_id"]),
            seen["process_path"] or "",
            seen["title"],
        )
        row = windows.get(key)
        if row is None:
            row = windows[key] = {
                **seen, "window_id": len(windows) + 1, "event_count": 0,
                "first_seen_at": e["occurred_at"], "last_seen_at": e["occurred_at"],
            }
        row.update({name: seen[name] for name in ("x", "y", "width", "height")})
        row["first_seen_at"] = min(row["first_seen_at"], e["occurred_at"])
        row["last_seen_at"] = max(row["last_seen_at"], e["occurred_at"])
        row["event_count"] += 1
        links.append(row["window_id"])
    return list(windows.values()), links


def as_set(rows):
    names = [n for n in WINDOW.names if n != "context_hash"]

    def value(row, name):
        v = row[name]
        return v.replace(tzinfo=None) if name.endswith("_at") else v

    return {tuple(value(row, name) for name in names) for row in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_build_equals_simulation(spark, seed):
    events = random_events(seed)
    wanted, _ = simulate(events)
    rows = dim.build_dimension(arrivals_of(spark, events).repartition(3)).collect()
    assert as_set(rows) == as_set(wanted)


def test_batches_in_order_equal_simulation(spark, tmp_path):
    events = random_events(3)
    wanted, links = simulate(events)
    store = TimelineStore(spark, str(tmp_path))
    for low, high in ((0, 1), (1, 70), (70, 120)):
        s = store.ingest(arrivals_of(spark, events[low:high], first_id=low + 1))
    assert s.version == 3
    assert as_set(s.windows.collect()) == as_set(wanted)
    assert [r["window_id"] for r in s.events.orderBy("event_id").collect()] == links
    report = s.constraint_report().where("violations > 0")
    assert report.isEmpty()


def test_fold_does_not_depend_on_cut_or_order(spark):
    events = random_events(4)
    wanted, _ = simulate(events)
    rows = arrivals_of(spark, events)
    parts = [
        materialise(dim.fold(dim.identity_partials(rows.where(f"event_id % 3 = {i}"))))
        for i in range(3)
    ]
    for order in ((0, 1, 2), (2, 0, 1)):
        first, second, third = (parts[i] for i in order)
        folded = dim.fold(dim.fold(first.unionByName(second)).unionByName(third))
        assert as_set(dim.number_windows(folded).collect()) == as_set(wanted)


def test_a_committed_batch_is_not_applied_twice(spark, tmp_path):
    store = TimelineStore(spark, str(tmp_path))
    rows = arrivals_of(spark, [event("a", window()), event("b", window())])
    batch = SourceBatch("feed", "s1", 0)
    store.ingest(rows, batch)
    s = store.ingest(rows, batch)
    assert (s.version, s.events.count(), s.windows.first()["event_count"]) == (1, 2, 2)


def test_an_unfinished_version_is_invisible_and_overwritten(spark, tmp_path):
    store = TimelineStore(spark, str(tmp_path))
    s = store.ingest(arrivals_of(spark, [event("a", window())]), SourceBatch("feed", "s1", 0))
    # A writer that died after its files and before its commit.
    s.log.drop("version").write.partitionBy("occurred_date").parquet(f"{tmp_path}/events/version=2")
    s = store.snapshot()
    assert s.events.count() == 1
    s = store.ingest(arrivals_of(spark, [event("b", window(x=9.0))], first_id=2), SourceBatch("feed", "s1", 1))
    assert [r["event_value"] for r in s.events.orderBy("event_id").collect()] == ["a", "b"]
    assert s.windows.first()["x"] == 9.0


def test_snapshot_stays_as_it_was(spark, tmp_path):
    store = TimelineStore(spark, str(tmp_path))
    before = store.ingest(arrivals_of(spark, [event("a", window())]))
    store.ingest(arrivals_of(spark, [event("b", window())], first_id=2))
    assert before.events.count() == 1
    assert before.windows.first()["event_count"] == 1


def test_advance_from_nothing(spark):
    current = spark.createDataFrame([], WINDOW_STATE)
    partials = materialise(dim.identity_partials(arrivals_of(spark, [event("a")])))
    following, pairs = dim.advance_dimension(current, partials, 0)
    assert following.isEmpty() and pairs.isEmpty()


def test_parts_fold_to_the_whole_dimension_and_compact(spark, tmp_path):
    events = random_events(7)
    store = TimelineStore(spark, str(tmp_path))
    for low in range(0, len(events), 9):
        s = store.ingest(arrivals_of(spark, events[low : low + 9], first_id=low + 1))
    wanted, _ = simulate(events)
    assert as_set(s.window_state.collect()) == as_set(wanted)
    after = store.compact()
    assert as_set(after.window_state.collect()) == as_set(wanted)
    assert [p.name for p in (tmp_path / "windows").glob("version=*")] == [f"version={after.version}"]
    assert store.compact().version == after.version
    more = [*events, *events[:5]]
    s = store.ingest(arrivals_of(spark, events[:5], first_id=len(events) + 1))
    assert as_set(s.window_state.collect()) == as_set(simulate(more)[0])


def test_ids_are_issued_and_enforced(spark, tmp_path):
    store = TimelineStore(spark, str(tmp_path / "a"))
    rows = arrivals_of(spark, [event(v, window()) for v in "cab"]).withColumnRenamed("event_id", "n")
    s = store.ingest(rows, order_by=["value"])
    assert [(r["event_id"], r["event_value"]) for r in s.events.orderBy("event_id").collect()] == [(1, "a"), (2, "b"), (3, "c")]
    s = store.ingest(rows.limit(1), order_by=["n"])
    assert s.last_event_id == 4
    with pytest.raises(ValueError, match="order_by"):
        store.ingest(rows.drop("n"))

    store = TimelineStore(spark, str(tmp_path / "b"))
    store.ingest(arrivals_of(spark, [event("a"), event("b", kind="odd")]))
    twice = arrivals_of(spark, [event("x")], first_id=1).union(arrivals_of(spark, [event("y"), event("z")], first_id=2))
    s = store.ingest(twice.union(arrivals_of(spark, [event("w")], first_id=3)))
    kept = s.events.groupBy("event_id").count().collect()
    assert sorted(tuple(r) for r in kept) == [(1, 1), (2, 1), (3, 1)] and s.event(1).count() == 1
    reasons = sorted((r["event_id"], r["reason"]) for r in store.quarantine().collect())
    assert reasons == [(1, "duplicate:event_id"), (2, "unknown_kind"), (3, "duplicate:event_id")]


def test_an_ingest_leaves_no_scratch(spark, tmp_path):
    from pathlib import Path

    from tideglass.session import scratch_folder

    store = TimelineStore(spark, str(tmp_path))
    tables = Path(scratch_folder(spark).removeprefix("file:")) / "tables"
    before = set(tables.glob("*")) if tables.exists() else set()
    store.ingest(arrivals_of(spark, [event("a", window()), event("b")]))
    store.ingest(arrivals_of(spark, [event("c", window("t2"))], first_id=3))
    assert set(tables.glob("*")) <= before


def test_a_cluster_takes_the_checkpoint_folder_on_a_mount(spark, tmp_path, monkeypatch):
    from tideglass.session import scratch_folder, shared_folder

    folder = scratch_folder(spark)
    assert folder.startswith("file:/")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    store = TimelineStore(spark, f"{folder}/stores/on_a_cluster")
    assert store.ingest(arrivals_of(spark, [event("a", window()), event("b")])).events.count() == 2
    plain = folder.removeprefix("file:").lstrip("/")
    assert shared_folder(spark, f"file:///{plain}/x") and shared_folder(spark, "hdfs://name/x")
    for other in (f"file://{tmp_path}/x", f"file:///{plain}-2/x", f"file:///{plain}/../x"):
        with pytest.raises(RuntimeError, match="own folder"):
            shared_folder(spark, other)


@pytest.mark.parametrize("limit", [dim.BROADCAST_BYTES, 0])
def test_a_batch_asks_the_dimension_for_its_own_windows(spark, monkeypatch, limit):
    monkeypatch.setattr(dim, "BROADCAST_BYTES", limit)
    old = dim.build_dimension(arrivals_of(spark, [event(f"o{i}", window(f"t{i}")) for i in range(40)]))
    parts = materialise(old.unionByName(old.where("window_id % 2 = 0")))
    batch = arrivals_of(spark, [event(f"n{i}", window(f"t{i}")) for i in range(38, 43)], first_id=100)
    partials = materialise(dim.identity_partials(batch))
    known = dim.known_pairs(parts, partials)
    pairs = {(r["context_hash"], r["window_id"]) for r in known.collect()}
    wanted = {r["context_hash"] for r in partials.collect()}
    stored = {(r["context_hash"], r["window_id"]) for r in old.collect()}
    assert {p for p in pairs if p[0] in wanted} == {p for p in stored if p[0] in wanted}
    assert len(known.collect()) == len(pairs) == (2 if limit else 40)
    ids = sorted(r["window_id"] for r in dim.dimension_part(known, partials, 40).collect())
    assert ids == [39, 40, 41, 42, 43]
    if limit:
        # The parts meet the hashes before anything of theirs is shuffled.
        plan = known._jdf.queryExecution().sparkPlan().toString()
        assert plan.index("HashAggregate") < plan.index("LeftSemi") and plan.count("Exchange") == 0
        lines = known._jdf.queryExecution().executedPlan().toString().splitlines()
        shuffle = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line)
        assert any("BroadcastHashJoin" in line and "LeftSemi" in line for line in lines[shuffle:])
