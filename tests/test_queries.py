"""Every codec query against its SQL on the smallest tables; the entry module's contract."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from blockloom.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = sorted(map(str, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))
    assert got
    if name in ORACLE_SQL:
        rel = con.sql(ORACLE_SQL[name])
        cols = sorted(rel.columns)
        assert cols == sorted(df.columns)
        rows = con.sql(f"select {', '.join(cols)} from ({ORACLE_SQL[name]})").fetchall()
        assert got == sorted(map(str, rows))


def test_contract(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
