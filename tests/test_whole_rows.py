import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")
@pytest.mark.parametrize("name", ["phrase_rows", "token_rows"])
def test_no_row_is_dropped(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    want = con.sql(entry.oracle_sql()[name])
    rows = want.fetchall()
    got = entry.queries()[name](spark, DATA).select(*want.columns).collect()
    assert len(rows) > 100 and sorted(map(tuple, got), key=repr) == sorted(rows, key=repr)
