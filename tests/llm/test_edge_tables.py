"""Every query over empty tables, and over tables with a NULL in every column, repeated rows and clashing columns."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom.llm import plans
from graphloom.plans import problems

DATA = os.environ.get("GRAPHLOOM_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
TABLES = ("diagrams", "descriptions", "sample_meta", "instructions", "sample_targets", "qa_pairs", "documents", "eval_items", "reading_labels")
ALL = plans.QUERIES | problems.QUERIES
#: One query of each operator and each of its other outputs; reports only add a count to these.
QUERIES = {n: f for n, f in ALL.items() if n.endswith("_found") or n in ("p1_sample", "p2_split", "p4_groups", "p5_components", "p6_descendants", "p7_pack", "p7_report", "p8_matches", "p9_levels")}
CLASHES = ("id", "key", "words", "val", "rec", "label", "tokens", "level", "defect", "tree", "node", "has", "rank")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{base}/{t}.parquet")
    return str(base)


@pytest.fixture(scope="module")
def holes(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("holes")
    for t in TABLES:
        df = spark.read.parquet(f"{DATA}/{t}.parquet")
        one = df.limit(1)
        out = df.unionByName(df.limit(3))
        for c, kind in df.dtypes:
            out = out.unionByName(one.withColumn(c, F.lit(None).cast(kind)))
            if kind == "string":
                out = out.unionByName(one.withColumn(c, F.lit(""))).unionByName(one.withColumn(c, F.lit("x y " * 30_000)))
        out = out.unionByName(one.select(*[F.lit(None).cast(k).alias(c) for c, k in df.dtypes]))
        out.select("*", *[F.lit(7).alias(c) for c in CLASHES if c not in df.columns]).coalesce(2).write.parquet(f"{base}/{t}.parquet")
    return str(base)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, empty, name):
    rows = QUERIES[name](spark, empty).count()
    assert rows == (1 if name == "p7_report" else 0)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_holes(spark, holes, name):
    df = QUERIES[name](spark, holes)
    rows = df.collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(map(tuple, rows)))
