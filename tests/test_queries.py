"""Every query with SQL, on the smallest tables, against another engine."""

import math

import duckdb
import pytest

from driftloom.plans import registry
from driftloom.plans.core import TABLES

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str([shown(x) for x in v]) if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(map(shown, r)) for r in df.select(*cols).collect())
    assert got, "a query that returns nothing shows nothing"
    if name in SQL:
        cur = duck.execute(SQL[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == cols
        assert got == sorted(tuple(shown(r[names.index(c)]) for c in cols) for r in cur.fetchall())
