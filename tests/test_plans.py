"""Plans that must stay as they are: pruned scans, pushed filters, no nested loop and no cross product of tables."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom.plans import catalogue, problems

DATA = os.environ.get("GRAPHLOOM_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_its_columns(spark):
    text = plan(catalogue.QUERIES["summary_by_model"](spark, DATA))
    assert "validation_errors" not in text.split("ReadSchema")[1]


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(is_valid), EqualTo(is_valid,true)" in plan(spark.read.parquet(f"{DATA}/diagrams.parquet").where("is_valid = true").select("diagram_id"))
    assert "GreaterThan" in plan(catalogue.QUERIES["edited_pairs_F8_J10"](spark, DATA))


@pytest.mark.parametrize("name", ["theta_name_match", "best_name_match", "left_join_tier", "incremental_todo", "all_models_present", "corruption_report"])
def test_no_nested_loop_between_tables(spark, name):
    text = plan(catalogue.QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text
    loops = text.count("BroadcastNestedLoopJoin")
    assert loops <= text.count("percentile(")  # only the one-row threshold may be joined without a key


def test_rank_filters_stop_early(spark):
    assert "WindowGroupLimit" in plan(catalogue.QUERIES["limit_per_domain_F14"](spark, DATA))


@pytest.mark.parametrize("parts", [1, 7])
def test_results_do_not_depend_on_partitions(spark, tmp_path, parts):
    """Rows delivered in another order and number of files give the same rows."""
    for t in ("diagrams", "descriptions"):
        spark.read.parquet(f"{DATA}/{t}.parquet").repartition(parts, F.rand(parts)).write.parquet(str(tmp_path / f"{t}.parquet"))
    for name in ("p5_found", "p6_found"):
        query = problems.QUERIES[name]
        assert query(spark, str(tmp_path)).exceptAll(query(spark, DATA)).isEmpty() and query(spark, DATA).exceptAll(query(spark, str(tmp_path))).isEmpty()
