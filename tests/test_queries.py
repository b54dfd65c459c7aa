"""Every query that has SQL gives the rows that DuckDB gives, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lodestrata.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p + ('/*.parquet' if os.path.isdir(p) else '')}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    got = duck.execute(ORACLE[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    rows = got.fetchall()
    assert found == sorted((tuple(r[names.index(c)] for c in cols) for r in rows), key=repr)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
