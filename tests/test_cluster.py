"""Queries under a cluster's master with the checkpoint folder on a mount, against their SQL in DuckDB."""

import sys
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")
sys.path.insert(0, str(ROOT / "tools"))

from check_oracle import rows_of  # noqa: E402
from tideglass.plans import fixtures, oracle  # noqa: E402
from tideglass.plans import queries as registry  # noqa: E402

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no given tables")

NAMES = [
    "constraint_report",
    "constraint_report_damaged",
    "dimension_compacted",
    "dimension_incremental",
    "dimension_running",
    "dimension_streaming",
    "event_by_id",
    "event_detail",
    "event_display",
    "event_list_items",
    "event_window_assignment",
    "events_all_filters",
    "events_by_app",
    "events_by_hash",
    "events_by_kind",
    "events_by_window",
    "events_count",
    "events_cursor",
    "events_deep_app_name_asc",
    "events_deep_app_name_desc",
    "events_deep_event_id_asc",
    "events_deep_event_id_desc",
]


@pytest.fixture(scope="module")
def cluster(spark):
    """The session under a cluster's master, without the stores that earlier tests built."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(spark.sparkContext, "master", "spark://host:7077")
        patch.setattr(fixtures, "_built", {})
        yield spark


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_a_query_runs_on_a_cluster(cluster, duck, name):
    df = registry.queries()[name](cluster, str(DATA))
    found = df.collect()
    cursor = duck.execute(oracle.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, found) == rows_of(columns, cursor.fetchall())
