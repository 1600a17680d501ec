"""Every catalogue query against its SQL on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from graphloom.plans import catalogue, problems

DATA = os.environ.get("GRAPHLOOM_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return v.isoformat() if isinstance(v, datetime.datetime) else repr(v)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows_as_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = con.execute(catalogue.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted((catalogue.QUERIES.keys() - catalogue.SQL.keys()) | problems.QUERIES.keys()))
def test_runs(spark, name):
    q = catalogue.QUERIES.get(name) or problems.QUERIES[name]
    assert q(spark, DATA).count() > 0


def test_names_are_there_without_a_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True, check=True)
    assert int(said.stdout.split()[0]) >= len(catalogue.QUERIES)
