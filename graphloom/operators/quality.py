"""Data quality and repair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import first_segment, last_segment


def corrupted(domain: Column, *paths: Column) -> Column:
    """Whether any known path names another domain than the row's."""
    checks = [F.coalesce(first_segment(p, "domain_") != domain, F.lit(False)) for p in paths]
    return reduce(lambda a, b: a | b, checks)


def clear_if_corrupted(metrics: Column, domain: Column, sample: Column, *paths: Column) -> Column:
    """The metrics, or an empty map if the first known path belongs to another domain or sample."""
    path = F.coalesce(*paths)
    bad = (last_segment(path, "domain_") != domain) | (last_segment(path, "sample_") != sample)
    return F.when(F.coalesce(bad, F.lit(False)), F.map_filter(metrics, lambda k, v: F.lit(False))).otherwise(metrics)


def failed_zero_to_null(score: Column, success: Column) -> Column:
    """A score of 0 that failed becomes NULL; a real 0 stays."""
    return F.when(~F.coalesce(success, F.lit(True)) & (score == 0), F.lit(None)).otherwise(score)


def zero_is_failure(score: Column, success: Column) -> tuple[Column, Column]:
    """Every 0 becomes NULL and failed; other scores succeed unless they say otherwise."""
    zero = F.coalesce(score == 0, F.lit(False))
    return F.when(~zero, score), F.when(zero, False).otherwise(F.coalesce(success, F.lit(True)))


def fill_level(level: Column, from_id: Column) -> Column:
    """An unknown level is taken from the id."""
    return F.when(F.coalesce(level, F.lit("unknown")) == "unknown", F.coalesce(from_id, F.lit("unknown"))).otherwise(level)


def corruption_report(df: DataFrame, model: str, domain: str, bad: Column) -> DataFrame:
    """Totals and rates per (model, domain), per model and overall, in one pass."""
    return df.withColumn("_bad", bad).rollup(model, domain).agg(
        F.count("*").alias("total"), F.count_if("_bad").alias("corrupted"), F.try_divide(F.count_if("_bad") * 100.0, F.count("*")).alias("rate")
    )


def missing_rows(detailed: DataFrame, fragments: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the detail table that no fragment has; ``keys`` is the full key, with the domain."""
    return detailed.join(fragments.select(*keys).distinct(), keys, "left_anti")
