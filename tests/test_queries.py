"""Every registered query against its SQL on the smallest data folder."""

import datetime
import decimal
import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


def plain(v):
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else float(v)
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e15:
        return int(v)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def table(names, rows):
    order = [names.index(c) for c in sorted(names)]
    return sorted(([plain(r[i]) for i in order] for r in rows), key=lambda r: [(v is None, type(v).__name__, str(v)) for v in r])


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    spark.catalog.clearCache()
    if name not in ORACLES:
        assert rows
        return
    result = db.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert table(df.columns, rows) == table(names, result.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
