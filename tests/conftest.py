import sys
from datetime import datetime, timezone
from decimal import Decimal
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from pyspark.sql import types as T  # noqa: E402

from tideglass.schemas import PAYLOAD  # noqa: E402
from tideglass.session import build_session  # noqa: E402
from tideglass.store import TimelineStore  # noqa: E402

ARRIVAL = T.StructType([T.StructField("event_id", T.LongType()), *PAYLOAD.fields])


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        **{
            "spark.master": "local[4]",
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            # Compiling every small plan costs more than running it; the SQL check tool
            # runs all queries with compiled plans.
            "spark.sql.codegen.wholeStage": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text: str = "2026-04-18T00:00:00") -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def window(title="cargo test", **changes):
    fields = {
        "app_name": "Terminal",
        "process_path": "/Applications/Utilities/Terminal.app",
        "process_id": Decimal(42),
        "title": title,
        "x": 0.0,
        "y": 0.0,
        "width": 1280.0,
        "height": 720.0,
    }
    return {**fields, **changes}


def event(value, seen=None, **changes):
    fields = {
        "occurred_at": at(),
        "kind": "key_press",
        "value": value,
        "delta_x": None,
        "delta_y": None,
        "window": seen,
        "raw_event": f'{{"value":"{value}"}}',
        "raw_window": None,
        "collector_name": "listener",
        "collector_version": "0.0.1-test",
    }
    return {**fields, **changes}


def arrivals_of(spark, events, first_id=1):
    rows = [{"event_id": first_id + i, **e} for i, e in enumerate(events)]
    return spark.createDataFrame(rows, ARRIVAL)


@pytest.fixture
def ingest(spark, tmp_path):
    """Store the given events and return the snapshot."""

    def run(*events):
        store = TimelineStore(spark, str(tmp_path / "store"))
        return store.ingest(arrivals_of(spark, list(events)))

    return run
