"""Queries of the two general problems: nested records (p5) and hierarchies (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.diagrams import nested_cells
from ..operators.flatten import DESCRIPTION_TABLES, flat_tables, links
from ..operators.hierarchy import descendants, hierarchy
from ..session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and parents of all flat tables."""
    return links(flat_tables(spark, table(spark, sf_dir, "diagrams"), table(spark, sf_dir, "descriptions")))


def _flat(record_kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        if record_kind in DESCRIPTION_TABLES:
            return flat_tables(spark, None, table(spark, sf_dir, "descriptions"))[record_kind].distinct()
        return flat_tables(spark, table(spark, sf_dir, "diagrams"), None)[record_kind].distinct()

    query.__doc__ = f"The flat table of {record_kind} records, each row once."
    return query


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = nested_cells(table(spark, sf_dir, "diagrams"), "diagram_id", "xml_content").select(F.col("doc_key").alias("diagram_id"), F.inline("cells"))
    # A cell without parent attribute, or with an empty one, has no parent, even beside a cell without id.
    return hierarchy(cells.select("diagram_id", "id", F.nullif("parent", F.lit("")).alias("parent")), "diagram_id", "id", "parent")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell with its root, depth and full path."""
    return _nodes(spark, sf_dir).select(F.col("tree").alias("diagram_id"), F.col("node").alias("cell_id"), "root_id", "depth", F.array_join("path", "/").alias("full_path"))


def p6_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell with each cell below it and how far below."""
    return descendants(_nodes(spark, sf_dir)).select(F.col("tree").alias("diagram_id"), "ancestor", F.col("node").alias("descendant"), "distance")


def p6_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells on loops and cells whose chain of parents runs into one, per diagram."""
    bad = _nodes(spark, sf_dir).where("depth < 0")
    return bad.groupBy(F.col("tree").alias("diagram_id")).agg(F.count_if(F.col("depth") == -1).alias("on_loop"), F.count_if(F.col("depth") == -2).alias("behind_loop"))


QUERIES = {
    "p5_found": p5_found,
    **{f"p5_{k}s": _flat(k) for k in ("cell", "point", "component", "port", "relationship")},
    "p6_found": p6_found,
    "p6_descendants": p6_descendants,
    "p6_loops": p6_loops,
}
