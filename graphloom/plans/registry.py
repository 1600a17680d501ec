"""How queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

_WIDER = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}


class Tables:
    """The tables of one data folder as attributes: ``t.qa_pairs``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


class Catalogue:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        """Register ``f(tables) -> DataFrame`` under ``name``; whole numbers come out as bigint, fractions as double."""

        def add(f: Callable[[Tables], DataFrame]):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                df = f(Tables(spark, sf_dir))
                return df.select(*[F.col(f"`{c}`").cast(_WIDER.get(kind, kind)).alias(c) for c, kind in df.dtypes])

            run.__doc__, run.__name__ = f.__doc__, name
            self.queries[name] = run
            if sql:
                self.sql[name] = sql
            return f

        return add
