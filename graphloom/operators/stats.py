"""Aggregations of score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def six_numbers(c: str, digits: int | None = None) -> list[Column]:
    """mean, median, std, min, max and count of the known values; std of one row is NULL."""
    own = F.col(c).cast("double")
    out = {"mean": F.avg(own), "median": F.percentile(own, 0.5), "std": F.stddev_samp(own), "min": F.min(own), "max": F.max(own)}
    return [(F.round(v, digits) if digits is not None else v).alias(f"{c}_{k}") for k, v in out.items()] + [F.count(own).alias(f"{c}_count")]


def summary(df: DataFrame, by: list[str], metrics: list[str], digits: int | None = None, rows: str | None = None) -> DataFrame:
    """Six numbers of each metric per group; groups with a NULL key are left out. ``rows`` names a column of row counts."""
    known = df.where(" AND ".join(f"{b} IS NOT NULL" for b in by)) if by else df
    extra = [F.count("*").alias(rows)] if rows else []
    return known.groupBy(*by).agg(*[x for m in metrics for x in six_numbers(m, digits)], *extra)


def dimension_stats(df: DataFrame, dimensions: list[str], digits: int = 2) -> DataFrame:
    """mean, std (0 for one row), min, max and count per dimension; the dimensions are columns."""
    long = df.unpivot([], [F.col(d).cast("double").alias(d) for d in dimensions], "dimension", "value")
    v = F.col("value")
    return long.groupBy("dimension").agg(
        F.round(F.avg(v), digits).alias("mean"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), digits).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n")
    )


def shares(df: DataFrame, by: str) -> DataFrame:
    """Value counts with percentages of all known values."""
    counted = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"))
    total = F.broadcast(df.agg(F.count(by).alias("_total")))  # one row
    return counted.crossJoin(total).select(by, "n", (F.col("n") * 100.0 / F.col("_total")).alias("percent"))


def cross_tab(df: DataFrame, by: str, over: str, values: list[str]) -> DataFrame:
    """Counts with one column per value in the given order, 0 where nothing is."""
    return df.groupBy(by).pivot(over, values).count().na.fill(0)


def quantiles(c: str, at: dict[str, float]) -> list[Column]:
    """Exact quantiles with linear interpolation."""
    return [F.percentile(F.col(c), p).alias(name) for name, p in at.items()]


def histogram(df: DataFrame, c: str, bins: int) -> DataFrame:
    """(bin, low, n, density); equal widths from least to greatest value, the last bin closed. NULLs are left out."""
    ends = df.agg(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"), F.count(c).alias("total"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(c) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("bigint")
    rows = df.where(F.col(c).isNotNull()).crossJoin(F.broadcast(ends))  # one row
    return rows.groupBy(at.alias("bin"), "lo", "hi", "total").agg(F.count("*").alias("n")).select(
        "bin", (F.col("lo") + F.col("bin") * width).alias("low"), "n", F.try_divide(F.col("n"), F.col("total") * width).alias("density")
    )


def success_rates(df: DataFrame, by: list[str], success: Column) -> DataFrame:
    """Successes, failures and the rate in percent, 0 where there is neither."""
    s, f = F.count_if(success), F.count_if(~success)
    return df.groupBy(*by).agg(s.alias("successes"), f.alias("failures"), F.coalesce(F.try_divide(s * 100.0, s + f), F.lit(0.0)).alias("rate"))


def merge_statistics(old: DataFrame, new: DataFrame, key: str, total: str, values: list[str]) -> DataFrame:
    """New statistics over old ones: new values win where there are any, totals take the greater."""
    o = old.select(F.col(key), *[F.col(c).alias(f"{c}_o") for c in [total, *values]])
    n = new.select(F.col(key), *[F.col(c).alias(f"{c}_n") for c in [total, *values]])
    return o.join(n, key, "full").select(
        key, F.greatest(f"{total}_o", f"{total}_n").alias(total), *[F.coalesce(f"{v}_n", f"{v}_o").alias(v) for v in values]
    )


def density_estimate(df: DataFrame, c: str, points: int = 50) -> DataFrame:
    """(x, density): a Gaussian kernel estimate at equal steps, with Scott's bandwidth.

    The values are counted into a grid eight times as fine first, so the kernel meets a bounded table.
    """
    fine = points * 8
    grid = histogram(df, c, fine).select((F.col("low")).alias("at"), "n")
    ends = df.agg(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"), F.stddev_samp(c).alias("sd"), F.count(c).alias("total"))
    x = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / float(points - 1))).alias("x")
    marks = ends.select("lo", "hi", (F.col("sd") * F.pow("total", F.lit(-0.2))).alias("h"), "total", x)
    middle = F.col("at") + (F.col("hi") - F.col("lo")) / (2.0 * fine)
    u = (F.col("x") - middle) / F.col("h")
    pairs = F.broadcast(marks).join(F.broadcast(grid), F.lit(True))  # points x 8 points rows
    return pairs.groupBy("x").agg((F.sum(F.col("n") * F.exp(-u * u / 2)) / F.first(F.col("total") * F.col("h") * 2.5066282746310002)).alias("density"))


def axis_bounds(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: a zone around all points with margins of 0.3 of their span, fixed sizes where there is no span, and the limits of the y axis."""
    b = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    mx, my = F.when(wide > 0, wide * 0.3).otherwise(0.05), F.when(high > 0, high * 0.3).otherwise(0.02)
    out = {
        "zone_x": F.col("x0") - mx, "zone_y": F.col("y0") - my, "zone_width": F.when(wide > 0, wide + 2 * mx).otherwise(0.15), "zone_height": F.when(high > 0, high + 2 * my).otherwise(0.05),
        "y_lower": F.col("y0") - high * 0.5, "y_upper": F.col("y1") + high * 0.2,
    }
    return b.select(*[F.round(c, 6).alias(n) for n, c in out.items()])
