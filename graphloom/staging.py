"""Intermediate tables in the folder that all executors share.

A staged table cuts the lineage as a checkpoint does, but is columnar, is
compressed and carries statistics. It survives the loss of executors, because
it lies in the folder named by ``spark.checkpoint.dir``. Only where that
setting is missing (tests, notebooks) a folder of this machine is used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _FALLBACK[app] = tempfile.mkdtemp(prefix="graphloom-")
    return "file://" + _FALLBACK[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


class Stage:
    """Staged tables of one run of an operator.

    ``put`` writes a frame and reads it back; ``drop`` deletes one that nothing
    reads any more. What is left is deleted at the end of the process, because
    the lazy result may still read it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/graphloom-{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        atexit.register(_delete, spark, self.base)

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_staged_path", None)
        if path:
            _delete(self.spark, path)
