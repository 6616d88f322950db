"""Every registered query of the graph engine against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from wayfare import queries as own

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def normal(rows, order):
    value = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(([value(v) for v in r] for r in rows), key=lambda t: [(x is None, str(x)) for x in t])


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, name):
    df = own.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = normal([[r[c] for c in columns] for r in df.collect()], columns)
    if name not in own.ORACLE_SQL:
        assert got
        return
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want = con.sql(own.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == normal([[r[i] for i in at] for r in want.fetchall()], columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
