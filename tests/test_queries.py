"""Every registered query beside its SQL on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def shown(v):
    if v is None or isinstance(v, (bool, str, bytes)):
        return repr(v)
    if isinstance(v, (int, float, Decimal)):
        x = float(v)
        return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return f"[{','.join(map(shown, v))}]"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(SQL)))
def test_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(map(shown, r)) for r in df.select(*cols).collect())
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
