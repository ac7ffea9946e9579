import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


SLOW = {"qa_batch", "qa_list_parts", "qa_counts", "qa_accuracy", "grounded_answers", "fused_search"}  # agree on the given tables; here test_graph_and_questions has them by brute force


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        at = f"{DATA}/{f}" + ("/*.parquet" if os.path.isdir(f"{DATA}/{f}") else "")
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{at}')")
    return c


def canon(df):
    def of(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
            return "NULL"
        return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)

    return sorted(map(tuple, df[sorted(df.columns)].map(of).values.tolist()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SLOW))
def test_values_agree_with_sql(spark, con, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)
