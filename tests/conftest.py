"""A local session for all tests, and the folders of given tables."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from sectionlake.session import build_session

    session = build_session(os.environ.get("TEST_CPUS", "4"), 4, "4g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def duck(sf_dir: str):
    """DuckDB with the tables of a folder as views."""
    import duckdb

    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{files}'")
    return con


def rows_of(frame) -> list[str]:
    """A pandas frame as sorted rows, columns by name; numbers at six digits, missing values as None."""

    def plain(v):
        if v is None or (isinstance(v, float) and v != v):
            return None
        if hasattr(v, "item"):
            v = v.item()
        return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v

    names = sorted(frame.columns)
    return sorted(repr([(n, plain(v)) for n, v in zip(names, row)]) for row in frame[names].itertuples(index=False, name=None))


def check_against_sql(spark, query, sql: str, sf_dir: str) -> None:
    got, want = rows_of(query(spark, sf_dir).toPandas()), rows_of(duck(sf_dir).execute(sql).df())
    assert len(got) == len(want)
    assert got == want
