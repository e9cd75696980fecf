"""Every core query with an oracle gives what its SQL gives, on the smallest driver tables."""

import datetime
import decimal
import os

import pytest

from codeloom.plans import core_oracles, core_queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
duckdb = pytest.importorskip("duckdb")


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(core_oracles()))
def test_same_as_sql(spark, sql, name):
    df = core_queries()[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = sql.execute(core_oracles()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert mine == sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(core_queries()) - set(core_oracles())))
def test_runs(spark, name):
    df = core_queries()[name](spark, DATA)
    assert df.columns and df.count() >= 0
