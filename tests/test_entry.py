"""The contract with the driver: names agree, and queries agree with their SQL."""

import glob
import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_all_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
def test_flagship_against_duckdb(spark):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want = con.sql(entry.oracle_sql()["flagship_instruction_safety"])
    got = entry.entry(spark)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())
