"""Sinks (K1-K15). Spark's commit protocol stands for temporary files and renames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_fragments(df: DataFrame, path: str, keys: list[str], mode: str = "overwrite") -> None:
    """JSON rows in folders by key. Rows are hashed by the keys and a salt first, so a folder has a few files and a large key has several writers."""
    salted = df.repartition(*[F.col(k) for k in keys], F.pmod(F.xxhash64(*df.columns), F.lit(4)))
    salted.write.mode(mode).partitionBy(*keys).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def review(df: DataFrame) -> DataFrame:
    """A review row per result: ``approved`` starts as ``is_candidate``."""
    return df.withColumn("approved", F.coalesce("is_candidate", F.lit(False)))


def nested(df: DataFrame, by: list[str], fields: list[str], name: str) -> DataFrame:
    """One document per key with a list of its rows. A document is a file by nature; its list must fit one row."""
    return df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


def write_documents(df: DataFrame, path: str) -> None:
    """Documents as lines of JSON, text as it is."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_results(df: DataFrame, path: str, keys: list[str]) -> None:
    """Whole results as Parquet by key: one table instead of five files per result."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_parts(parts: dict[str, DataFrame], path: str) -> None:
    """The parts of results, each a folder of JSON rows with the keys of the results: a metadata, a diagram, a description, the whole result."""
    for name, df in parts.items():
        write_documents(df, f"{path}/{name}")


def delete_folders(spark: SparkSession, files: DataFrame) -> int:
    """Delete the folders of rows read from files, as one ``find ... -delete`` would; gives their number.

    Only names of folders come to the driver, as many as there are keys in the folder structure.
    """
    folders = files.select(F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("f")).distinct().collect()
    for r in folders:
        target = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(r.f))
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return len(folders)


def delete_rows(df: DataFrame, condition: str) -> DataFrame:
    """What stays after a delete: rows for which the condition is false or unknown."""
    return df.where(f"NOT coalesce({condition}, false)")
