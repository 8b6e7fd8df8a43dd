"""Every registered query of the library runs at the smallest scale and agrees with its SQL."""

import datetime as dt

import duckdb
import pytest

from vectrill import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool) or isinstance(x, str):
        return str(x)
    if isinstance(x, dt.datetime):
        return str(x.replace(tzinfo=None))
    return str(float(x) + 0.0) if isinstance(x, (int, float)) else str(x)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in values], key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    table = got.toArrow()
    values = list(zip(*(table.column(i).to_pylist() for i in range(table.num_columns)), strict=True))
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert values
        return
    wanted = duck.sql(sql)
    assert sorted(wanted.columns) == sorted(got.columns)
    assert rows(got.columns, values) == rows(wanted.columns, wanted.fetchall())
