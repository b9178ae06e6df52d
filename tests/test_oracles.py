"""Every registered query against its DuckDB counterpart, or for rows alone where there is none."""

import math
import os

import pytest

import __spark_entry__ as entry
from loomsift.catalog import ORACLES, QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=str)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in ORACLES:
        assert got
        return
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    want = want.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    assert rows(df.columns, got) == rows(names, want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) >= set(ORACLES)
