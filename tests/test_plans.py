"""Every registered query that SQL can express gives the rows that DuckDB gives on the same files."""

from __future__ import annotations

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from agora.plans import registry
from tests.conftest import DATA

PLANS, SQL = registry.queries(), registry.oracle_sql()


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, (float, Decimal)):
        return round(float(value), 5)
    return value


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, tables, name):
    found = PLANS[name](spark, DATA)
    wanted = tables.sql(SQL[name])
    columns = sorted(wanted.columns)
    assert sorted(found.columns) == columns
    a = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    b = sorted((tuple(plain(dict(zip(wanted.columns, r))[c]) for c in columns) for r in wanted.fetchall()), key=repr)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(SQL)))
def test_gives_rows(spark, name):
    assert PLANS[name](spark, DATA).count() > 0
