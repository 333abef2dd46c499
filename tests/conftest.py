"""One small local session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pairforge.session import build_session

    return build_session("local[4]", shuffle_partitions=4)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def check(spark, sf):
    """check(run, sql): the query's rows against DuckDB's."""
    from tools.compare import duck, rows_of

    con = duck(sf)

    def compare(run, sql: str) -> int:
        df = run(spark, sf)
        names, rows = rows_of(df.columns, df.collect())
        cur = con.execute(sql)
        assert (names, rows) == rows_of([d[0] for d in cur.description], cur.fetchall())
        return sum(rows.values())

    return compare
