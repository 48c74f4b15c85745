"""Every registered query against its SQL in DuckDB, over whole tables."""

import datetime
import decimal

import duckdb
import pytest

from answerlens.plans import catalog
from answerlens.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        return float(f"{float(x):.9g}")
    return str(x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if name in SQL:
        r = duck.execute(SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        assert got == sorted(repr([plain(row[names.index(c)]) for c in cols]) for row in r.fetchall())
