"""The order of rows and the number of files must not change a result."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom.llm import plans

DATA = os.environ.get("GRAPHLOOM_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
TABLES = ("diagrams", "sample_meta", "instructions", "sample_targets", "qa_pairs", "documents", "eval_items", "reading_labels")


@pytest.mark.parametrize("parts", [1, 6])
def test_found_rows(spark, tmp_path, parts):
    for t in TABLES:
        spark.read.parquet(f"{DATA}/{t}.parquet").repartition(parts, F.rand(parts)).write.parquet(str(tmp_path / f"{t}.parquet"))
    for name in ("p1_found", "p1_sample", "p2_found", "p2_split", "p3_found", "p4_found", "p8_matches", "p9_found"):
        one, two = ({tuple(r) for r in plans.QUERIES[name](spark, d).collect()} for d in (DATA, str(tmp_path)))
        assert one == two, name
