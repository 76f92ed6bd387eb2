"""Every query against its SQL twin on the smallest tables."""

import glob
import os

import duckdb
import pytest

from pulsefield.plans import catalog
from pulsefield.session import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        if glob.glob(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def comparable(rows):
    show = lambda v: "~" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    twin = duck.sql(catalog.oracle_sql()[name])
    assert sorted(twin.columns) == columns
    kinds = dict(zip(twin.columns, map(str, twin.types), strict=True))
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    rows = twin.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert comparable(map(tuple, df.select(*columns).collect())) == comparable(rows)
