"""Every query with SQL against DuckDB on the smallest test data, where that is there."""

import os

import pytest

from stratiform.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", [n for n in ORACLE_SQL if not n.startswith("stream")])
def test_matches_duckdb(spark, name):
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want = db.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    mine = sorted(str(tuple(r)) for r in df.select(*order).collect())
    theirs = sorted(str(r) for r in want.select(", ".join(f'"{c}"' for c in order)).fetchall())
    assert mine == theirs
