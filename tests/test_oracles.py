"""Every query with SQL gives the same rows as an independent engine on the same files."""

import sys
from pathlib import Path

import duckdb
import pytest

from conftest import SMALL

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402


@pytest.fixture(scope="module")
def connection():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, connection, name):
    outcome, _ = check.compare(spark, connection, name, SMALL)
    assert outcome.startswith("ok"), outcome


def test_entry(spark):
    assert entry.entry(spark).count() == 145


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
