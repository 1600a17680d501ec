"""The results store (I1-I10): long rows, the last write wins.

A result is a row (keys, metric, seq, payload). Nothing is updated in place: a
new fragment is appended, and the view takes the payload with the greatest
sequence per key and metric. That is one map-side combined aggregation.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """The payload of the last row per key; ``order`` must be unique within a key. A NULL payload of the last row stays."""
    last = F.max_by(F.struct(*payload), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in payload])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows over old ones: an old row stays unless a new one has its keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def merge_metric_maps(old: DataFrame, new: DataFrame, keys: list[str], metrics: str) -> DataFrame:
    """Documents with a map of metrics: entries of the new map win, others are kept; unknown keys are appended."""
    o, n = old.select(*keys, F.col(metrics).alias("_o")), new.select(*keys, F.col(metrics).alias("_n"))
    none = F.create_map().cast("map<string,double>")
    o_, n_ = F.coalesce("_o", none), F.coalesce("_n", none)
    kept = F.map_filter(o_, lambda k, v: ~F.coalesce(F.map_contains_key(n_, k), F.lit(False)))
    return o.join(n, keys, "full").select(*keys, F.map_concat(kept, n_).alias(metrics))


def complete_keys(scores: DataFrame, keys: list[str], enabled: list[str]) -> DataFrame:
    """Keys that need no work: every enabled metric is there, succeeded and is not NULL."""
    valid = scores.where(F.col("metric").isin(enabled) & F.col("score").isNotNull() & F.coalesce("success", F.lit(False)))
    return valid.groupBy(*keys).agg(F.countDistinct("metric").alias("_n")).where(F.col("_n") == len(set(enabled))).drop("_n")


def still_to_do(keys_table: DataFrame, scores: DataFrame, keys: list[str], enabled: list[str]) -> DataFrame:
    """(keys, metric) that must be computed: enabled metrics without a valid score."""
    wanted = keys_table.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(m) for m in enabled])).alias("metric"))
    valid = scores.where(F.col("score").isNotNull() & F.coalesce("success", F.lit(False))).select(*keys, "metric").distinct()
    return wanted.join(valid, [*keys, "metric"], "left_anti")


def wide(scores: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per key and one column per metric, whatever its success; one value per cell is expected, the greatest counts."""
    return scores.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, F.col("score"))).alias(m) for m in metrics])


class ScoreCache:
    """Scores kept by key for the length of a session: computed at the first use, read from the executors' storage afterwards.

    Blocks that do not fit into memory go to disk, and blocks of a lost executor are computed again.
    """

    def __init__(self, scores: DataFrame, keys: list[str]):
        self.keys, self._scores = keys, scores
        self._kept: DataFrame | None = None

    def get(self, **key: str) -> DataFrame:
        """The rows of a key, or of a part of it; all without one."""
        if self._kept is None:
            self._kept = self._scores.persist(StorageLevel.MEMORY_AND_DISK)
        rows = self._kept
        for name, value in key.items():
            if name not in self.keys:
                raise KeyError(name)
            rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
        return rows

    def clear(self) -> None:
        """Forget the rows, so that the next use computes them anew."""
        if self._kept is not None:
            self._kept.unpersist()
            self._kept = None
