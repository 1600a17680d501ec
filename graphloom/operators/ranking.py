"""Ordering, numbering and sampling (W*, U*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import Stage


def screen_top(df: DataFrame, score: str, candidate: Column, n: int, *ties: str) -> DataFrame:
    """All rows with ``is_candidate``: if more than n are candidates, only the n best rows stay so; no row is removed.

    The best n come from a top-n scan, so no window runs over all rows.
    """
    rows = df.withColumn("is_candidate", candidate)
    best = rows.orderBy(F.desc(score), *ties).limit(n).select(*ties, F.lit(True).alias("kept"))
    many = rows.agg((F.count_if("is_candidate") > n).alias("many"))
    joined = rows.join(F.broadcast(best), list(ties), "left").crossJoin(F.broadcast(many))
    kept = F.coalesce("kept", F.lit(False))
    return joined.withColumn("reason", F.when(F.col("many") & F.col("is_candidate") & ~kept, F.lit(f"not among the best {n}"))).withColumn(
        "is_candidate", F.when(F.col("many"), F.col("is_candidate") & kept).otherwise(F.col("is_candidate"))
    ).drop("kept", "many")


def first_preferred(df: DataFrame, by: list[str], preferred: Column, *order: str) -> DataFrame:
    """One row per group: a preferred one if there is any, else the first by the order."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(preferred.desc(), *order))
    return df.withColumn("_n", rank).where("_n = 1").drop("_n")


def number_onwards(df: DataFrame, order: list[str], start: Column | int, buckets: int = 64) -> DataFrame:
    """``number`` counts the rows on from ``start`` in the given order.

    Ranges of the order are counted apart and shifted by what lies before them, so no task sees all rows.
    """
    parts = df.repartitionByRange(buckets, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    # Written once: both the places and the sizes of the ranges come from the same ranges, also if a task runs again.
    inside = Stage(df.sparkSession, "number").put(parts.withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("bigint"), 33)))
    sizes = inside.groupBy("_p").count()
    before = F.broadcast(sizes.withColumn("_b", F.sum("count").over(Window.orderBy("_p")) - F.col("count")).select("_p", "_b"))
    base = F.lit(start) if isinstance(start, int) else start
    return inside.join(before, "_p").withColumn("number", base + F.col("_b") + F.col("_i")).drop("_p", "_b", "_i")


def first_k(df: DataFrame, c: str, k: int) -> DataFrame:
    """The first k distinct values in alphabetical order."""
    return df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(k)


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: str = "42") -> DataFrame:
    """A proportional sample of n rows by strata.

    The alphabetically first stratum goes in whole. Of the others, largest first,
    each takes its share of n (at least one row), capped by its size and by what
    is left; what remains is filled in the same order. Rows are drawn by the hash
    of seed and key. The sequential rule is a running sum over the strata, whose
    number alone sets the size of the window.
    """
    sizes = df.groupBy(stratum).agg(F.count("*").alias("size"))
    first = sizes.agg(F.min(stratum).alias("first"))
    s = sizes.crossJoin(F.broadcast(first))
    whole = F.sum(F.when(F.col(stratum) == F.col("first"), F.col("size")).otherwise(0)).over(Window.partitionBy())
    s = s.withColumn("rest", F.greatest(F.lit(0), F.lit(n) - whole)).withColumn("others", F.sum(F.when(F.col(stratum) != F.col("first"), F.col("size")).otherwise(0)).over(Window.partitionBy()))
    is_other = F.col(stratum) != F.col("first")
    order = Window.partitionBy(is_other).orderBy(F.desc("size"), stratum)
    want = F.least(F.greatest(F.lit(1), F.floor(F.col("size") / F.col("others") * F.col("rest"))), F.col("size"))
    s = s.withColumn("want", want).withColumn("upto", F.sum("want").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("alloc", F.least("upto", "rest") - F.least(F.col("upto") - F.col("want"), F.col("rest")))
    s = s.withColumn("given", F.sum(F.when(is_other, F.col("alloc")).otherwise(0)).over(Window.partitionBy())).withColumn("cap", F.when(F.col("alloc") > 0, F.col("size") - F.col("alloc")).otherwise(0))
    s = s.withColumn("cap_upto", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("open", F.col("rest") - F.col("given"))
    s = s.withColumn("more", F.least("cap_upto", "open") - F.least(F.col("cap_upto") - F.col("cap"), F.col("open")))
    take = F.when(is_other, F.col("alloc") + F.col("more")).otherwise(F.col("size"))
    quota = s.select(stratum, take.cast("bigint").alias("take"))
    # Rows are ranked by their hash. Counts per range of the hash tell in which range a quota ends; only that range is sorted.
    rows = df.join(F.broadcast(quota), stratum).withColumn("_h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))).withColumn("_r", F.substring("_h", 1, 2))
    per = rows.groupBy(stratum, "_r", "take").agg(F.count("*").alias("_n"))
    per = per.withColumn("_b", F.sum("_n").over(Window.partitionBy(stratum).orderBy("_r")) - F.col("_n")).where("_b < take").drop("take")
    kept = rows.join(F.broadcast(per), [stratum, "_r"])
    rank = F.row_number().over(Window.partitionBy(stratum, "_r").orderBy("_h", key))
    edge = kept.where("_b + _n > take").withColumn("_k", rank).where("_b + _k <= take").drop("_k")
    return kept.where("_b + _n <= take").unionByName(edge).select(*df.columns)
