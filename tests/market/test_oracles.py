"""Every market query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import market

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        connection.sql(f"create view {file.stem} as select * from '{file}'")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool | str):
        return value
    return round(float(value), 5) + 0.0


def rows(table):
    columns = sorted(table)
    key = lambda row: [(v is None, str(v)) for v in row]
    return columns, sorted(([plain(v) for v in row] for row in zip(*(table[c] for c in columns), strict=True)), key=key)


@pytest.mark.parametrize("name", sorted(market.QUERIES))
def test_query(spark, db, name):
    got = market.QUERIES[name](spark, SF).toArrow().to_pydict()
    if name not in market.ORACLE_SQL:
        assert got and next(iter(got.values()))
        return
    columns, found = rows(got)
    expected_columns, expected = rows(db.sql(market.ORACLE_SQL[name]).to_arrow_table().to_pydict())
    assert columns == expected_columns
    assert len(found) == len(expected)
    for a, b in zip(found, expected, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5) for x, y in zip(a, b, strict=True)), (a, b)
