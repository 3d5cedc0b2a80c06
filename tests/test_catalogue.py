"""Every catalogue query against its SQL on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from gleaner.plans import audits, catalogue, joins, more  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 9)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return int(v) if isinstance(v, bool) else v


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(d[0] for d in want.description)
    assert rows(df.columns, got) == rows([d[0] for d in want.description], want.fetchall())
