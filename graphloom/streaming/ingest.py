"""Incremental ingestion: new fragments appear, the last write wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.store import latest
from ..staging import Stage


def merge_stream(spark: SparkSession, folder: str, glob: str, schema: StructType, keys: list[str], order: list[str], payload: list[str], files_per_batch: int = 100) -> DataFrame:
    """Read all files of ``folder`` that fit ``glob`` as a stream and keep the last payload per key.

    Each micro-batch is reduced to one row per key and appended under its batch
    number, so a batch that runs twice replaces itself. The view is the same
    reduction over all batches: late fragments only win if their order says so.
    """
    stage = Stage(spark, "stream")
    batches, checkpoint = f"{stage.base}/batches", f"{stage.base}/checkpoint"

    def put(batch: DataFrame, number: int) -> None:
        kept = latest(batch, keys, order, list(dict.fromkeys([*order, *payload])))
        kept.write.mode("overwrite").parquet(f"{batches}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", glob).parquet(folder)
    run = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    columns = list(dict.fromkeys([*keys, *order, *payload]))
    written = spark.read.schema(StructType([f for f in schema.fields if f.name in columns])).parquet(batches)
    return latest(written, keys, order, payload)


def counts_by_window(stream: DataFrame, time: str, by: str, width: str = "5 minutes", lateness: str | None = "10 minutes") -> DataFrame:
    """Counts per key and time window, for streaming or batch frames; without ``lateness`` an earlier watermark holds."""
    rows = stream.withWatermark(time, lateness) if lateness else stream
    return rows.groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def without_repeats(stream: DataFrame, keys: list[str], time: str, lateness: str = "1 hour") -> DataFrame:
    """Rows delivered twice within the lateness once."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)
