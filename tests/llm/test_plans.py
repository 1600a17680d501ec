import os

import duckdb
import pytest

from graphloom.llm import plans

DATA = os.environ.get("GRAPHLOOM_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, DATA).columns


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("instructions", "sample_meta", "sample_targets", "documents", "eval_items"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cursor = con.execute(plans.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(tuple(r[c] for c in columns) for r in plans.QUERIES[name](spark, DATA).collect()) == sorted(cursor.fetchall())
