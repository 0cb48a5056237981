"""Every query with a SQL twin gives what DuckDB gives, at the smallest scale."""

import datetime
import math

import duckdb
import pytest

from skyobs.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "customer supplier part orders lineitem".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def _cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, datetime.date):
        return str(v)[:10]
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v) + 0.0:.5f}"
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(tuple(_cell(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(SQL[name])
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_geojson_of_many_suppliers_matches_sql(spark, tmp_path):
    # cells at the south pole, whose boxes end there, and below the grid's last row
    shifted = "SELECT * REPLACE (l_suppkey + 51140 + 100*(l_orderkey % 90) AS l_suppkey)"
    duck = duckdb.connect()
    duck.sql(f"COPY ({shifted} FROM '{DATA}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    duck.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got, want = QUERIES["explore_geojson"](spark, str(tmp_path)), duck.sql(SQL["explore_geojson"])
    rows = [tuple(r) for r in got.collect()]
    assert any(51_157 <= r[0] <= 51_504 for r in rows) and any(r[0] > 51_504 for r in rows)
    assert _rows(got.columns, rows) == _rows(want.columns, want.fetchall())
