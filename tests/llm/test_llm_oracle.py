"""Operators that SQL can express against their SQL in DuckDB, on the smallest given tables."""

import sys
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

ROOT = Path(__file__).resolve().parents[2]
DATA = Path("/root/testdata/sf0.001")
sys.path.insert(0, str(ROOT / "tools"))

from check_oracle import rows_of  # noqa: E402
from tideglass.llm import oracle  # noqa: E402
from tideglass.llm import queries as registry  # noqa: E402


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query(spark, name):
    duck = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = registry.queries()[name](spark, str(DATA))
    cursor = duck.execute(oracle.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())
