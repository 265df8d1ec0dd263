"""Every query that SQL can express, against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as e
from tessel.plans import ORACLE_SQL

SF = "/root/testdata/sf0.01"


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(repr(tuple(str(r[k]) if r[k] is not None else None for k in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    want = con.execute(e.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    want = table(want.fetchall(), columns)
    frame = e.queries()[name](spark, SF)
    got = table([tuple(r) for r in frame.collect()], frame.columns)
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[1]
