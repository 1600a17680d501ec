"""Scans and sinks (S1-S7, S14-S21, K1, K2), descriptions (P32) and calls (G*) as queries.

Most write documents made from a table to the shared folder, read them back with
the reader in question, and must give the table's own rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..functions.diagrams import nested_descriptions
from ..functions.text import folded
from ..operators import adapters
from ..sources import readers, writers
from ..staging import Stage
from .registry import Catalogue, Tables
from .text_queries import DOMAIN

C = Catalogue()
q = C.query


def _key():
    return [folded(F.col("domain")).alias("domain"), F.col("sample_id")]


def _folder(t: Tables, name: str) -> str:
    return Stage(t.spark, name).base


def _diagrams(t: Tables):
    return t.diagrams.select(*_key(), "diagram_id", "model_used", "is_valid", "xml_content").distinct()


@q("batches_S2", f"SELECT DISTINCT {DOMAIN} AS batch FROM diagrams")
def _(t: Tables):
    """Batches are folder names of the files."""
    base = _folder(t, "batches")
    writers.write_fragments(_diagrams(t).select("domain", "diagram_id"), base, ["domain"])
    files = t.spark.read.schema("diagram_id bigint").option("recursiveFileLookup", True).json(base)
    return files.select(F.regexp_extract("_metadata.file_path", r"domain=([^/]*)", 1).alias("batch")).distinct()


@q("batch_rows_S3_S6", f"SELECT DISTINCT {DOMAIN} AS domain, sample_id, diagram_id FROM diagrams")
def _(t: Tables):
    """All batches as one table; documents that cannot be read are left out."""
    base = _folder(t, "batch")
    writers.write_fragments(_diagrams(t).select("domain", "sample_id", "diagram_id"), base, ["domain"])
    rows = t.spark.read.schema("sample_id string, diagram_id bigint, domain string, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(base)
    return rows.where("_corrupt IS NULL").select("domain", "sample_id", "diagram_id")


@q("assembled_results_S4_S5", f"""WITH s AS (SELECT DISTINCT {DOMAIN} AS domain, sample_id FROM sample_meta), d AS (SELECT {DOMAIN} AS domain, sample_id, min(diagram_id) AS diagram_id FROM diagrams GROUP BY ALL), e AS (SELECT DISTINCT {DOMAIN} AS domain, sample_id FROM descriptions),
k AS (SELECT domain, sample_id FROM s UNION SELECT domain, sample_id FROM d UNION SELECT domain, sample_id FROM e)
SELECT k.domain, k.sample_id, s.sample_id IS NOT NULL AS has_metadata, d.sample_id IS NOT NULL AS has_diagram, e.sample_id IS NOT NULL AS has_description, CASE WHEN d.diagram_id % 2 = 0 THEN 'result' WHEN d.diagram_id IS NOT NULL THEN 'part' END AS origin
FROM k LEFT JOIN s USING (domain, sample_id) LEFT JOIN d USING (domain, sample_id) LEFT JOIN e USING (domain, sample_id)""")
def _(t: Tables):
    """Results written as parts, some of them as whole documents too, read back and put together; what was there is a flag, and the whole document wins."""
    base, key = _folder(t, "results"), "domain string, sample_id string"
    diagram = t.diagrams.groupBy(*_key()).agg(F.min("diagram_id").alias("diagram_id"))
    writers.write_parts({
        "metadata": t.sample_meta.select(*_key()).distinct(),
        "diagram": diagram.select("domain", "sample_id", F.lit("part").alias("origin")),
        "description": t.descriptions.select(*_key()).distinct(),
        "result": diagram.where("diagram_id % 2 = 0").select("domain", "sample_id", F.lit("result").alias("origin")),
    }, base)
    read = readers.read_parts(t.spark, base, {"metadata": key, "diagram": key + ", origin string", "description": key, "image": key, "result": key + ", origin string"})
    whole = read.pop("result")
    return readers.load_results(read, ["domain", "sample_id"], whole).drop("has_image")


@q("result_parts_K1", f"""WITH d AS (SELECT DISTINCT {DOMAIN} AS domain, sample_id, diagram_id, xml_content, is_valid, node_count, edge_count, model_used FROM diagrams)
SELECT diagram_id, xml_content, is_valid, node_count::BIGINT AS node_count, model_used FROM d WHERE diagram_id IS NOT NULL""")
def _(t: Tables):
    """Each result as a diagram, a metadata, a performance and a whole document, and the parts read back and joined."""
    base = _folder(t, "parts")
    d = t.diagrams.select("diagram_id", "xml_content", "is_valid", "node_count", "model_used", *_key()).distinct().where("diagram_id IS NOT NULL")
    writers.write_parts({
        "diagram": d.select("diagram_id", "xml_content"), "metadata": d.select("diagram_id", "is_valid", "node_count"), "performance": d.select("diagram_id", "model_used"),
        "result": d.select("diagram_id", F.struct("domain", "sample_id", "is_valid", "node_count").alias("result")),
    }, base)
    read = readers.read_parts(t.spark, base, {"diagram": "diagram_id bigint, xml_content string", "metadata": "diagram_id bigint, is_valid boolean, node_count bigint", "performance": "diagram_id bigint, model_used string"})
    return read["diagram"].join(read["metadata"], "diagram_id").join(read["performance"], "diagram_id")


@q("review_S7", "SELECT doc_id, n_chars >= 600 AS approved FROM documents")
def _(t: Tables):
    """A review is a JSON array; one array per thousand keys."""
    base = _folder(t, "review")
    rows = writers.review(t.documents.select("doc_id", (F.col("n_chars") >= 600).alias("is_candidate")))
    arrays = rows.groupBy(F.floor(F.col("doc_id") / 1000).alias("g")).agg(F.to_json(F.collect_list(F.struct("doc_id", "approved"))).alias("value"))
    arrays.select("value").write.text(base)
    return t.spark.read.text(base).select(F.inline(F.from_json("value", "array<struct<doc_id:bigint,approved:boolean>>")))


@q("render_work_list_S14", f"SELECT DISTINCT diagram_id, {DOMAIN} || '/' || sample_id || '/diagram.xml' AS xml_path, {DOMAIN} || '/' || sample_id || '/diagram.png' AS png_path FROM diagrams WHERE xml_content IS NOT NULL")
def _(t: Tables):
    files = _diagrams(t).where("xml_content IS NOT NULL").select("diagram_id", F.concat_ws("/", "domain", "sample_id", F.lit("diagram.xml")).alias("path"))
    return readers.work_list(files, ["diagram_id"])


@q("parquet_round_trip_S17_K1", f"SELECT DISTINCT {DOMAIN} AS domain, diagram_id, xml_content FROM diagrams WHERE {DOMAIN} = 'domain_software_domain_uml'")
def _(t: Tables):
    """Whole results as Parquet by domain; the filter prunes folders."""
    base = _folder(t, "results")
    writers.write_results(_diagrams(t).select("domain", "diagram_id", "xml_content"), base, ["domain"])
    return t.spark.read.parquet(base).where("domain = 'domain_software_domain_uml'").select("domain", "diagram_id", "xml_content")


@q("sample_documents_S18", f"""WITH s AS (SELECT DISTINCT {DOMAIN} AS domain, sample_id FROM sample_meta), x AS (SELECT DISTINCT {DOMAIN} AS domain, sample_id, length(xml_content) AS xml_length FROM diagrams)
SELECT domain, sample_id, xml_length FROM s LEFT JOIN x USING (domain, sample_id)""")
def _(t: Tables):
    """The documents of a sample, read from the folders in which they were written; a missing file is NULL."""
    base, key = _folder(t, "documents"), "domain string, sample_id string"
    writers.write_parts({"metadata": t.sample_meta.select(*_key()).distinct(), "diagram": _diagrams(t).select("domain", "sample_id", "xml_content")}, base)
    read = readers.read_parts(t.spark, base, {"metadata": key, "diagram": key + ", xml_content string"})
    return read["metadata"].join(read["diagram"], ["domain", "sample_id"], "left").select("domain", "sample_id", F.length("xml_content").alias("xml_length"))


@q("detail_to_fragments_S19", "SELECT event_id, event_type FROM events")
def _(t: Tables):
    """Detail documents of a type, one per thousand ids, split into rows, written as fragments and read again."""
    base = _folder(t, "detail")
    row = F.to_json(F.struct("event_id", "event_type"))
    docs = t.events.groupBy("event_type", F.floor(F.col("event_id") / 1000).alias("g")).agg(F.concat(F.lit('{"instructions":['), F.array_join(F.collect_list(row), ","), F.lit("]}")).alias("doc"))
    writers.write_fragments(readers.rows_of_documents(docs, "doc", "array<struct<event_id:bigint,event_type:string>>", ["samples", "instructions"]), base, ["event_type"])
    return readers.read_fragments(t.spark, base, "event_id bigint, event_type string")


@q("file_sizes_S1_S21", f"SELECT {DOMAIN} AS domain, sum(length(diagram_id::VARCHAR) + 1)::BIGINT AS bytes FROM (SELECT DISTINCT domain, sample_id, diagram_id, xml_content, model_used, is_valid FROM (SELECT DISTINCT {DOMAIN} AS domain, sample_id, diagram_id, xml_content, model_used, is_valid FROM diagrams)) GROUP BY 1")
def _(t: Tables):
    """Files listed by ending, each path once, with their bytes by folder; contents are not read. A line has an id and its end."""
    base = _folder(t, "files")
    _diagrams(t).select("domain", F.col("diagram_id").cast("string").alias("line")).write.partitionBy("domain").text(base)
    files = readers.find_images(t.spark, base, endings=("txt",)).withColumn("domain", F.regexp_extract("path", r"domain=([^/]*)", 1))
    return readers.sizes_by(files, "domain").select("domain", "bytes")


@q("batch_summary_K2", f"SELECT {DOMAIN} AS domain, count(DISTINCT diagram_id) AS total, count(DISTINCT diagram_id) FILTER (is_valid) AS valid, count(DISTINCT diagram_id) FILTER (NOT is_valid) AS invalid FROM diagrams GROUP BY 1")
def _(t: Tables):
    """The summary document of each batch, read back."""
    base = _folder(t, "summary")
    d = _diagrams(t).groupBy("domain").agg(F.count("*").alias("total"), F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"))
    writers.write_documents(d, base)
    return t.spark.read.schema("domain string, total bigint, valid bigint, invalid bigint").json(base)


@q("descriptions_P32")
def _(t: Tables):
    """Descriptions of any shape: components, relationships, layout and palette per document.

    The layout has type and direction from ``primary_layout`` ('unknown' and '' where it is missing) and layers from ``relative_positions``;
    a layout that is no JSON object stays NULL. Names of colours are lower-cased; those without name or value are left out.
    """
    parsed = nested_descriptions(t.descriptions, "description_id", "components", "relationships").distinct()
    layout = F.try_parse_json(F.col("spatial_layout").cast("string"))
    primary = F.coalesce(F.try_variant_get(layout, "$.primary_layout", "string"), F.try_variant_get(layout, "$.type", "string"))
    there = F.startswith(F.schema_of_variant(layout), F.lit("OBJECT"))
    palette = F.map_filter(F.coalesce("color_scheme", F.create_map().cast("map<string,string>")), lambda k, v: (F.length(k) > 0) & (F.length(v) > 0))
    own = t.descriptions.select(
        F.col("description_id").alias("doc_key"), F.when(there, F.coalesce(primary, F.lit("unknown"))).alias("layout_type"), F.when(there, F.coalesce(primary, F.lit(""))).alias("layout_direction"),
        F.when(there, F.coalesce(F.size(F.try_variant_get(layout, "$.relative_positions", "array<variant>")), F.lit(0))).alias("layers"),
        F.array_sort(F.transform(F.map_entries(palette), lambda e: F.concat_ws("=", F.lower(e["key"]), e["value"]))).alias("palette"),
    ).distinct()
    return parsed.select("doc_key", F.size("components").alias("components"), F.size("relations").alias("relations")).join(own, "doc_key").withColumnRenamed("doc_key", "description_id").withColumn("palette", F.array_join("palette", ","))


@q("recorded_calls_G1_G9", "SELECT DISTINCT pair_id, CASE WHEN pair_id % 4 = 0 THEN NULL ELSE answer END AS answer FROM qa_pairs WHERE question IS NOT NULL")
def _(t: Tables):
    """Prompts rendered, replies of a recorded run joined by the prompt's hash, and the answer read from the fenced JSON; every fourth prompt was never sent."""
    p = t.qa_pairs.where("question IS NOT NULL").select("pair_id", "question", "answer").distinct()
    prompt = sc.render(F.lit("#{{id}} {{question}}"), id=F.col("pair_id"), question=F.col("question"))
    p = p.withColumn("prompt", prompt)
    reply = F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.struct("answer")), F.lit("\n```"))
    recorded = p.where("pair_id % 4 != 0").select(adapters.prompt_key(F.col("prompt")).alias("prompt_key"), reply.alias("reply"))
    answered = adapters.with_recorded_replies(p.select("pair_id", "prompt"), "prompt", recorded)
    return answered.select("pair_id", F.get_json_object(sc.strip_fence(F.replace("reply", F.lit("Sure:\n"), F.lit(""))), "$.answer").alias("answer"))
