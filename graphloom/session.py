"""Session defaults. Everything here can be overridden by the caller's configuration."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``master`` only for local use."""
    builder = SparkSession.builder.appName("graphloom")
    if master:
        builder = builder.master(master).config("spark.sql.shuffle.partitions", os.environ.get("GRAPHLOOM_PARTITIONS", "8"))
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, for explicit repartitions ahead of Python stages."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
