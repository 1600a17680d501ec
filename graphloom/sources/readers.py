"""Scans (S1-S21). Folder names that carry keys become columns; documents of several shapes become rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import last_segment

#: Image endings.
IMAGE_ENDINGS = ("png", "jpg", "jpeg", "gif", "bmp", "tiff", "webp")


def find_images(spark: SparkSession, directory: str, recursive: bool = True, endings: tuple[str, ...] = IMAGE_ENDINGS) -> DataFrame:
    """(path, size), each path once, sorted; endings in either case. A missing directory raises. Contents are not read."""
    glob = "*.{" + ",".join(e for x in endings for e in (x.lower(), x.upper())) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(directory)
    return files.select("path", F.col("length").alias("size")).distinct().orderBy("path")


def with_path_keys(df: DataFrame, marks: dict[str, str]) -> DataFrame:
    """Columns from the file's path: ``{"domain": "domain_", "sample_id": "sample_"}``; the last segment that fits counts."""
    path = F.col("_metadata.file_path")
    return df.select("*", *[last_segment(path, start).alias(name) for name, start in marks.items()])


def read_documents(spark: SparkSession, path: str, schema: str, marks: dict[str, str] | None = None) -> DataFrame:
    """One row per JSON file, with keys from its path; a broken file gives a row whose ``_corrupt`` is set."""
    df = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").schema(schema + ", _corrupt string").json(path)
    return with_path_keys(df, marks) if marks else df


def read_texts(spark: SparkSession, path: str, marks: dict[str, str], ending: str = "*.xml") -> DataFrame:
    """One row per text file with its keys."""
    df = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", ending).text(path)
    return with_path_keys(df, marks)


def read_fragments(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Results in folders ``key=value``; filters on the keys prune folders."""
    return spark.read.schema(schema).json(path)


def existing_fragments(spark: SparkSession, path: str, schema: str, model: str | None = None, domain: str | None = None) -> DataFrame:
    """The results that exist in folders by model and domain: of one (model, domain), of a model, of a domain, or all. Folders that do not fit are not read."""
    rows = read_fragments(spark, path, schema)
    for name, value in (("model", model), ("domain", domain)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows


def rows_of_documents(df: DataFrame, document: str, rows: str, names: list[str]) -> DataFrame:
    """The rows of documents that hold a list under one of the names, or are the list."""
    doc = F.try_parse_json(F.col(document))
    listed = F.coalesce(*[F.try_variant_get(doc, f"$.{n}", rows) for n in names], F.try_variant_get(doc, "$", rows))
    return df.select(F.inline(listed))


def content_items(df: DataFrame, key: str, content: str, kind: str) -> DataFrame:
    """(key, place, fields of the item) of the items of one type; places count from 1 in the document."""
    items = df.select(key, F.posexplode(content).alias("_p", "_i")).where(F.col("_i.type") == kind)
    return items.select(key, (F.col("_p") + 1).alias("place"), "_i.*")


def load_results(parts: dict[str, DataFrame], key: list[str], whole: DataFrame | None = None) -> DataFrame:
    """One row per result folder, put together from optional parts; ``has_<part>`` says which were there.

    Where a whole result document exists, its columns win over those of the parts.
    """
    keys = None
    for df in [*parts.values(), *([whole] if whole is not None else [])]:
        keys = df.select(*key) if keys is None else keys.unionByName(df.select(*key))
    out = keys.distinct()
    for name, df in parts.items():
        out = out.join(df.withColumn(f"has_{name}", F.lit(True)), key, "left").fillna(False, [f"has_{name}"])
    if whole is not None:
        w = whole.select(*key, *[F.col(c).alias(f"_w_{c}") for c in whole.columns if c not in key])
        out = out.join(w, key, "left")
        for c in [c for c in whole.columns if c not in key]:
            out = out.withColumn(c, F.coalesce(f"_w_{c}", c) if c in out.columns else F.col(f"_w_{c}")).drop(f"_w_{c}")
    return out


def read_parts(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The parts of results that ``writers.write_parts`` wrote; one that was never written is an empty table."""
    out = {}
    for name, schema in schemas.items():
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
        out[name] = spark.read.schema(schema).json(f"{path}/{name}") if there else spark.createDataFrame([], schema)
    return out


def work_list(xml_files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, xml path, png path) of every XML file that is to be rendered."""
    return xml_files.select(*keys, F.col("path").alias("xml_path"), F.regexp_replace("path", r"\.xml$", ".png").alias("png_path"))


def sizes_by(files: DataFrame, key: str) -> DataFrame:
    """Number and bytes of files per key."""
    return files.groupBy(key).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
