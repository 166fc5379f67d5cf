"""Every registered algebra query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from assertia.queries import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    cursor = db.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    assert set(ORACLES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(
    ("name", "pushed", "unread"),
    [
        ("select_eq", "EqualTo(o_orderstatus,F)", "o_orderdate"),
        ("select_lt", "LessThan(o_totalprice,50000.0)", "o_orderdate"),
        ("select_between", "LessThanOrEqual(l_quantity,12.0)", "l_extendedprice"),
        ("derive_join", "GreaterThan(o_totalprice,300000.0)", "o_custkey"),
    ],
)
def test_predicates_reach_the_scan(spark, name, pushed, unread):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("FileScan")[1:] if pushed in x.split("ReadSchema")[0]]
    assert scans and all(unread not in x.split("ReadSchema")[1].split("\n")[0] for x in scans)
    if name.startswith("select"):
        assert "Python" not in plan and "Exchange" not in plan


def test_digest_is_of_the_sorted_ids(spark):
    from assertia.functions.blake3 import content_address
    from assertia.functions.canon import encode

    ids = [f"orders:{r.o_orderkey}" for r in spark.read.parquet(f"{DATA}/orders.parquet").collect()]
    assert QUERIES["set_digest"](spark, DATA).first().digest == content_address(encode(sorted(ids)))
