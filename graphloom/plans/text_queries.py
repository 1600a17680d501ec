"""Projections and predicates (P*, F*) as queries."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths as pa
from ..functions import scoring as sc
from ..functions.text import folded
from .registry import Catalogue, Tables

C = Catalogue()
q = C.query
TRIM = "E' \\t\\n\\r'"
DOMAIN = f"lower(trim(domain, {TRIM}))"


def in_list(words: tuple[str, ...], text: str) -> str:
    """DuckDB: how many of the words occur in the text."""
    return "(" + " + ".join(f"CASE WHEN contains({text}, '{w.replace(chr(39), chr(39) * 2)}') THEN 1 ELSE 0 END" for w in words) + ")"


@q("token_count", "SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS tokens FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", sc.token_estimate(F.col("text")).alias("tokens"))


@q("token_count_exact")
def _(t: Tables):
    """The tokens of the same texts by a public tokenizer where it is installed, else the estimate."""
    path = os.environ.get("GRAPHLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
    if importlib.util.find_spec("tokenizers") is None or not os.path.exists(path):
        return t.instructions.select("instruction_key", sc.token_estimate(F.col("instruction")).alias("tokens")).distinct()

    @F.pandas_udf("int")
    def exact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True
        for texts in batches:
            encoded = own.encode_batch(texts.fillna("").tolist(), add_special_tokens=False)
            yield pd.Series([len(e.ids) for e in encoded]).where(texts.notna().to_numpy())

    return t.instructions.select("instruction_key", "instruction").distinct().select("instruction_key", exact("instruction").alias("tokens"))


@q("word_count", r"SELECT doc_id, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END::BIGINT AS words FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", sc.word_count(F.col("text")).alias("words"))


@q("model_short_name", "SELECT DISTINCT model_used AS model, split_part(model_used, '/', -1) AS short FROM diagrams")
def _(t: Tables):
    return t.diagrams.select(F.col("model_used").alias("model"), pa.short_name(F.col("model_used")).alias("short")).distinct()


@q("file_safe_name", r"SELECT DISTINCT generation_model AS model, replace(replace(generation_model, '/', '_'), '\', '_') AS file FROM qa_pairs")
def _(t: Tables):
    return t.qa_pairs.select(F.col("generation_model").alias("model"), pa.file_name_of(F.col("generation_model")).alias("file")).distinct()


@q("safe_filename_P6", r"""SELECT DISTINCT description_id, trim(regexp_replace(regexp_replace(regexp_replace(title, '[<>:"/\\|?*]', '_', 'g'), '[\x00-\x1f\x7f]', '', 'g'), '[_\s]+', '_', 'g'), '._') AS file FROM descriptions""")
def _(t: Tables):
    return t.descriptions.select("description_id", pa.safe_file_name(F.col("title")).alias("file")).distinct()


@q("content_hash_P7", "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", *[sc.content_hash(F.col("text"), a).alias(a) for a in ("md5", "sha1", "sha256")])


@q("human_size_P8", "SELECT doc_id, CASE WHEN n_chars * 1000 < 1024 THEN format('{:.1f} B', n_chars * 1000.0) WHEN n_chars * 1000 < 1048576 THEN format('{:.1f} KB', n_chars * 1000 / 1024.0) ELSE format('{:.1f} MB', n_chars * 1000 / 1048576.0) END AS size FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", pa.human_size(F.col("n_chars") * 1000).alias("size"))


PATHS = f"SELECT DISTINCT {DOMAIN} AS domain, sample_id, instruction_id, '/data/benchmark/' || {DOMAIN} || '/' || sample_id || '/domain_copy/instructions/' || instruction_id || '/model_a/diagram.xml' AS path FROM instructions"


def _paths(t: Tables):
    d = folded(F.col("domain"))
    path = F.concat(F.lit("/data/benchmark/"), d, F.lit("/"), F.col("sample_id"), F.lit("/domain_copy/instructions/"), F.col("instruction_id"), F.lit("/model_a/diagram.xml"))
    return t.instructions.select(d.alias("domain"), "sample_id", "instruction_id", path.alias("path")).distinct()


@q("path_domain_first", f"WITH p AS ({PATHS}) SELECT path, regexp_extract(path, '(?:^|/)(domain_[^/]*)', 1) AS first_domain FROM p")
def _(t: Tables):
    return _paths(t).select("path", pa.first_segment(F.col("path"), "domain_").alias("first_domain"))


@q("path_domain_last", f"WITH p AS ({PATHS}) SELECT path, 'domain_copy' AS last_domain, sample_id AS sample, instruction_id AS inst FROM p")
def _(t: Tables):
    p = F.col("path")
    return _paths(t).select("path", *[pa.last_segment(p, s).alias(n) for n, s in (("last_domain", "domain_"), ("sample", "sample_"), ("inst", "inst_"))])


@q("relative_path_P11", f"WITH p AS ({PATHS}) SELECT path, substr(path, 7) AS below_benchmark, substr(path, 17) AS below_domain FROM p")
def _(t: Tables):
    p = F.col("path")
    return _paths(t).select("path", pa.below_marker(p, "benchmark").alias("below_benchmark"), pa.below_marker(p, "no_such_folder").alias("below_domain"))


@q("path_repair_P12_P13", f"WITH p AS ({PATHS}) SELECT path, true AS absolute, substr(path, 7) AS repaired, substr(path, 7) AS repaired_again FROM p")
def _(t: Tables):
    fixed = pa.relative(F.col("path"), "benchmark")
    return _paths(t).select("path", pa.is_absolute(F.col("path")).alias("absolute"), fixed.alias("repaired"), pa.relative(fixed, "benchmark").alias("repaired_again"))


LEVEL_COLUMNS = f"""
  CASE WHEN starts_with(instruction_id, 'inst_') THEN upper(substr(split_part(instruction_id, '_', 2), 1, 1)) || lower(substr(split_part(instruction_id, '_', 2), 2)) END"""


@q("level_resolution_P14_P17", f"""WITH x AS (SELECT DISTINCT instruction_key, instruction_id, difficulty_level, {LEVEL_COLUMNS} AS lv FROM instructions)
SELECT instruction_key, lv AS from_id, CASE WHEN lv IN ('Easy', 'Medium', 'Hard') THEN lv END AS strict,
       coalesce(difficulty_level, lv, 'unknown') AS stored_first,
       coalesce(CASE WHEN lv IN ('Easy', 'Medium', 'Hard') THEN lv END, CASE WHEN lower(trim(difficulty_level)) NOT IN ('unknown', 'none', '') THEN difficulty_level END) AS id_first FROM x""")
def _(t: Tables):
    i, d = F.col("instruction_id"), F.col("difficulty_level")
    return t.instructions.select(
        "instruction_key", sc.level_from_id(i).alias("from_id"), sc.strict_level_from_id(i).alias("strict"), sc.level_stored_first(d, i).alias("stored_first"), sc.level_id_first(d, i).alias("id_first")
    ).distinct()


@q("tier_of_dimensions_P19", """WITH x AS (SELECT instruction_key, (5 + instruction_key % 16)::BIGINT AS score FROM instructions)
SELECT DISTINCT instruction_key, score, CASE WHEN score BETWEEN 5 AND 8 THEN 'Easy' WHEN score BETWEEN 9 AND 12 THEN 'Medium' WHEN score BETWEEN 13 AND 18 THEN 'Hard' END AS tier FROM x""")
def _(t: Tables):
    s = F.col("instruction_key") % 16 + 5
    return t.instructions.select("instruction_key", s.alias("score"), sc.tier_of_dimensions(s).alias("tier")).distinct()


@q("operations_fit_P20", """SELECT DISTINCT instruction_key, CASE lower(trim(difficulty_level)) WHEN 'easy' THEN atomic_operation_count BETWEEN 1 AND 2 WHEN 'medium' THEN atomic_operation_count BETWEEN 3 AND 4
 WHEN 'hard' THEN atomic_operation_count BETWEEN 5 AND 7 END AS fits FROM instructions""")
def _(t: Tables):
    return t.instructions.select("instruction_key", sc.operations_fit(F.col("difficulty_level"), F.col("atomic_operation_count")).alias("fits")).distinct()


@q("metric_score_P21", "SELECT DISTINCT diagram_id, CASE WHEN coalesce(is_valid, true) THEN generation_time END AS score FROM diagrams")
def _(t: Tables):
    return t.diagrams.select("diagram_id", sc.metric_score(F.col("generation_time"), F.col("is_valid")).alias("score")).distinct()


@q("success_coercion", "SELECT DISTINCT pair_id, CASE WHEN answer IS NULL THEN true ELSE lower(trim(answer)) IN ('true', '1', 'yes') END AS success FROM qa_pairs")
def _(t: Tables):
    return t.qa_pairs.select("pair_id", sc.coerce_success(F.col("answer")).alias("success")).distinct()


FAMILY = "lower(generation_model || CASE WHEN pair_id % 5 = 0 THEN '-GPT' WHEN pair_id % 5 = 1 THEN '-claude' WHEN pair_id % 5 = 2 THEN '-Gemini' WHEN pair_id % 5 = 3 THEN '-qwen' ELSE '' END)"


@q("family_case", f"""WITH x AS (SELECT DISTINCT pair_id, {FAMILY} AS m FROM qa_pairs)
SELECT CASE WHEN contains(m, 'gpt') THEN 'GPT' WHEN contains(m, 'claude') THEN 'Claude' WHEN contains(m, 'gemini') THEN 'Gemini' WHEN contains(m, 'qwen') THEN 'Qwen' ELSE 'Other' END AS family, contains(m, 'gemini') AS gemini, count(*) AS pairs FROM x GROUP BY ALL""")
def _(t: Tables):
    """P23 and F16 over model names with a family's name added."""
    tail = F.get(F.array(*[F.lit(x) for x in ("-GPT", "-claude", "-Gemini", "-qwen", "")]), F.col("pair_id") % 5)
    m = t.qa_pairs.select("pair_id", F.concat("generation_model", tail).alias("m")).distinct()
    return m.groupBy(sc.model_family(F.col("m")).alias("family"), sc.is_gemini(F.col("m")).alias("gemini")).agg(F.count("*").alias("pairs"))


@q("display_names_P24_P25", f"""SELECT DISTINCT split_part(model_used, '/', -1) AS model_name, list_aggregate(list_transform(string_split(replace({DOMAIN}[8:], '_', ' '), ' '), lambda w: upper(w[1:1]) || w[2:]), 'string_agg', ' ') AS title FROM diagrams""")
def _(t: Tables):
    return t.diagrams.select(pa.display_name(F.col("model_used")).alias("model_name"), pa.domain_title(folded(F.col("domain"))).alias("title")).distinct()


@q("strip_fence_P26", r"""SELECT DISTINCT diagram_id, CASE WHEN regexp_extract(xml_content, '(?s)^\s*```[A-Za-z]*\s*\n(.*?)\n?\s*```\s*$', 1) != '' THEN regexp_extract(xml_content, '(?s)^\s*```[A-Za-z]*\s*\n(.*?)\n?\s*```\s*$', 1) ELSE xml_content END AS inside FROM diagrams""")
def _(t: Tables):
    return t.diagrams.select("diagram_id", sc.strip_fence(F.col("xml_content")).alias("inside")).distinct()


@q("extract_xml_P27", r"""WITH x AS (SELECT DISTINCT diagram_id, xml_content AS r, instr(xml_content, '```xml') AS a, instr(xml_content, '```') AS b, regexp_extract(xml_content, '(?s)(<mxGraphModel.*</mxGraphModel>)', 1) AS bare FROM diagrams),
y AS (SELECT diagram_id, a, b, bare, r, CASE WHEN a > 0 THEN substr(r, a + 6) ELSE substr(r, b + 3) END AS rest FROM x)
SELECT diagram_id, CASE WHEN a > 0 OR b > 0 THEN trim(CASE WHEN instr(rest, '```') > 0 THEN substr(rest, 1, instr(rest, '```') - 1) ELSE rest END, E' \t\n\r') WHEN bare != '' THEN bare ELSE trim(r) END AS xml FROM y""")
def _(t: Tables):
    return t.diagrams.select("diagram_id", sc.extract_xml(F.col("xml_content")).alias("xml")).distinct()


@q("first_number_P28", r"SELECT DISTINCT pair_id, try_cast(nullif(regexp_extract(answer, '[0-9]+\.?[0-9]*', 0), '') AS DOUBLE) AS number FROM qa_pairs")
def _(t: Tables):
    return t.qa_pairs.select("pair_id", sc.first_number(F.col("answer")).alias("number")).distinct()


@q("json_detail_extract", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t: Tables):
    noisy = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```"))
    return t.events.select("event_id", F.try_variant_get(sc.json_of(noisy), "$.k", "bigint").alias("k"))


@q("change_list_P30", "SELECT DISTINCT instruction_key, len(atomic_operations)::BIGINT AS changes FROM instructions WHERE atomic_operations IS NOT NULL")
def _(t: Tables):
    """A change per operation as JSON, read back as object or bare list; items without both keys are dropped."""
    item = lambda o: F.struct(o.alias("original_fragment"), F.upper(o).alias("modified_fragment"))
    bare = F.to_json(F.transform("atomic_operations", item))
    text = F.when(F.col("instruction_key") % 2 == 0, bare).otherwise(F.concat(F.lit('{"reasoning": "x", "changes": '), bare, F.lit("}")))
    rows = t.instructions.where("atomic_operations IS NOT NULL").select("instruction_key", text.alias("reply")).distinct()
    return rows.select("instruction_key", F.size(sc.changes_of(F.col("reply"))).alias("changes"))


@q("truncated_json_P31", r"""SELECT DISTINCT description_id, NOT regexp_matches(trim(right(components, 100)), '[}\]]\s*(```)?\s*$') OR (length(components) - length(replace(components, '"', ''))) % 2 = 1 AS truncated FROM descriptions""")
def _(t: Tables):
    return t.descriptions.select("description_id", sc.looks_truncated(F.col("components")).alias("truncated")).distinct()


@q("context_text_P33", r"""SELECT DISTINCT description_id, nullif(concat_ws(E'\n', CASE WHEN coalesce(title, '') != '' THEN 'Caption: ' || title END, CASE WHEN coalesce(diagram_type, '') != '' THEN 'Label: ' || diagram_type END, CASE WHEN coalesce(summary, '') != '' THEN 'Context: ' || summary END), '') AS context FROM descriptions""")
def _(t: Tables):
    return t.descriptions.select("description_id", sc.context_text(F.col("title"), F.col("diagram_type"), F.col("summary")).alias("context")).distinct()


@q("render_template_P34_P35", """SELECT DISTINCT pair_id, CASE WHEN pair_id % 2 = 0 THEN 'Q: ' || question || ' / A: ' || coalesce(answer, '') ELSE 'Check ' || coalesce(answer, '') || ' against ' || question END AS prompt FROM qa_pairs""")
def _(t: Tables):
    """Templates are a small keyed table (two versions here); a version that is unknown would find no row."""
    versions = t.spark.createDataFrame([(0, "Q: {{ question }} / A: {{answer}}"), (1, "Check {{answer}} against {{question}}")], "version int, template string")
    rows = t.qa_pairs.select("pair_id", "question", "answer").distinct().withColumn("version", (F.col("pair_id") % 2).cast("int"))
    return rows.join(F.broadcast(versions), "version").select("pair_id", sc.render(F.col("template"), question=F.col("question"), answer=F.col("answer")).alias("prompt"))


@q("canonical_json_tokens_P36", "SELECT event_id, greatest(1, length(props) // 4)::BIGINT AS tokens FROM events")
def _(t: Tables):
    squeezed = F.replace(F.col("props"), F.lit(": "), F.lit(":"))
    return t.events.select("event_id", sc.token_estimate(sc.canonical_json(squeezed)).alias("tokens"))


@q("prefix_cut_P37", "SELECT doc_id, left(text, 500) AS head, left(text, 100) AS short FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", F.left("text", F.lit(500)).alias("head"), F.left("text", F.lit(100)).alias("short"))


@q("data_url_P38", "SELECT DISTINCT instruction_key, 'data:image/png;base64,' || base64(encode(instruction)) AS url FROM instructions")
def _(t: Tables):
    return t.instructions.select("instruction_key", sc.data_url(F.encode("instruction", "UTF-8")).alias("url")).distinct()


@q("clamp_P39", "SELECT event_id, greatest(0.0, least(1.0, value / 100 - 0.1)) AS clamped FROM events")
def _(t: Tables):
    return t.events.select("event_id", sc.clamp(F.col("value") / 100 - 0.1).alias("clamped"))


@q("token_totals_P40", f"SELECT DISTINCT {DOMAIN} AS domain, sample_id, calculated_at, (coalesce(xml_token_count, 0) + coalesce(element_count, 0))::BIGINT AS total FROM sample_meta")
def _(t: Tables):
    total = F.coalesce("xml_token_count", F.lit(0)) + F.coalesce("element_count", F.lit(0))
    return t.sample_meta.select(folded(F.col("domain")).alias("domain"), "sample_id", "calculated_at", total.alias("total")).distinct()


@q("clean_questions_P41", """WITH x AS (SELECT DISTINCT instruction_key, list_transform(list_filter(coalesce(atomic_operations, []), lambda o: trim(o) != ''), lambda o: trim(o) || '?') AS qs FROM instructions)
SELECT instruction_key, array_to_string(CASE WHEN len(qs) > 0 THEN qs ELSE ['Is it done?'] END, '|') AS questions FROM x""")
def _(t: Tables):
    cleaned = sc.clean_questions(F.coalesce("atomic_operations", F.array().cast("array<string>")), "Is it done?")
    return t.instructions.select("instruction_key", F.array_join(cleaned, "|").alias("questions")).distinct()


TYPES = "CASE WHEN lower(trim(question_type)) IN ('counting', 'identification', 'relationship') THEN lower(trim(question_type)) END"


@q("complete_types_P42", f"""WITH p AS (SELECT DISTINCT pair_id, {DOMAIN} AS domain, sample_id, {TYPES} AS ty FROM qa_pairs),
g AS (SELECT domain, sample_id, list_sort(list(DISTINCT ty) FILTER (ty IS NOT NULL)) AS have FROM p GROUP BY ALL)
SELECT domain, sample_id, array_to_string((coalesce(have, []) || list_filter(['counting', 'identification', 'relationship'], lambda w: NOT list_contains(coalesce(have, []), w)))[1:3], ',') AS types FROM g""")
def _(t: Tables):
    ty = F.lower(F.trim("question_type"))
    p = t.qa_pairs.select("pair_id", folded(F.col("domain")).alias("domain"), "sample_id", F.when(ty.isin("counting", "identification", "relationship"), ty).alias("ty")).distinct()
    g = p.groupBy("domain", "sample_id").agg(F.array_sort(F.collect_set("ty")).alias("have"))
    return g.select("domain", "sample_id", F.array_join(sc.complete_types(F.col("have"), ["counting", "identification", "relationship"], 3), ",").alias("types"))


# --- predicates ---------------------------------------------------------------


@q("domain_filter_F1_F2", f"SELECT DISTINCT diagram_id FROM diagrams WHERE {DOMAIN} IN ('domain_business_domain_flowchart', 'domain_software_domain_uml') AND split_part(model_used, '/', -1) IN ('sketch-large', 'vista-2')")
def _(t: Tables):
    wanted = [d if d.startswith("domain_") else f"domain_{d}" for d in ("business_domain_flowchart", "domain_software_domain_uml")]
    return t.diagrams.where(folded(F.col("domain")).isin(wanted) & pa.short_name(F.col("model_used")).isin("sketch-large", "vista-2")).select("diagram_id").distinct()


@q("nullsafe_nonzero", f"SELECT DISTINCT {DOMAIN} AS domain, sample_id, calculated_at, xml_token_count::BIGINT AS xml_token_count FROM sample_meta WHERE xml_token_count IS DISTINCT FROM 0")
def _(t: Tables):
    """zero rows go, unknown ones stay."""
    return t.sample_meta.where(~F.col("xml_token_count").eqNullSafe(0)).select(folded(F.col("domain")).alias("domain"), "sample_id", "calculated_at", "xml_token_count").distinct()


@q("threshold_filter", "SELECT event_id, value FROM events WHERE value / 100 >= 0.6")
def _(t: Tables):
    return t.events.where(F.col("value") / 100 >= sc.CANDIDATE_SCORE).select("event_id", "value")


STATUS = "CASE WHEN is_valid IS NULL THEN 'pending' WHEN is_valid THEN 'approved' ELSE 'rejected' END"


@q("status_filter_F4_F6", f"SELECT DISTINCT diagram_id, {STATUS} AS status, coalesce(is_valid, false) AS approved FROM diagrams WHERE {STATUS} IN ('approved', 'pending')")
def _(t: Tables):
    status = F.when(F.col("is_valid").isNull(), "pending").when(F.col("is_valid"), "approved").otherwise("rejected")
    return t.diagrams.select("diagram_id", status.alias("status"), F.coalesce("is_valid", F.lit(False)).alias("approved")).where(F.col("status").isin("approved", "pending")).distinct()


@q("missing_files_F7", f"""WITH m AS (SELECT DISTINCT {DOMAIN} AS domain, sample_id FROM sample_meta), d AS (SELECT DISTINCT {DOMAIN} AS domain, sample_id, diagram_id FROM diagrams WHERE xml_content IS NOT NULL)
SELECT m.domain, m.sample_id, diagram_id FROM m JOIN d USING (domain, sample_id)""")
def _(t: Tables):
    key = [folded(F.col("domain")).alias("domain"), "sample_id"]
    d = t.diagrams.where("xml_content IS NOT NULL").select(*key, "diagram_id").distinct()
    return t.sample_meta.select(*key).distinct().join(d, ["domain", "sample_id"], "left").where("diagram_id IS NOT NULL")


@q("single_question_F9", f"""WITH p AS (SELECT DISTINCT pair_id, {DOMAIN} AS domain, sample_id FROM qa_pairs), g AS (SELECT domain, sample_id, count(*) AS n FROM p GROUP BY ALL)
SELECT domain, count(*) AS samples, count(*) FILTER (n = 1) AS single, round(100.0 * count(*) FILTER (n = 1) / count(*), 6) AS percent FROM g GROUP BY domain""")
def _(t: Tables):
    p = t.qa_pairs.select("pair_id", folded(F.col("domain")).alias("domain"), "sample_id").distinct().groupBy("domain", "sample_id").count()
    one = F.count_if(F.col("count") == 1)
    return p.groupBy("domain").agg(F.count("*").alias("samples"), one.alias("single"), F.round(one * 100.0 / F.count("*"), 6).alias("percent"))


@q("keyword_screen", f"SELECT doc_id, least(1.0::DOUBLE, {in_list(sc.SCREEN_WORDS, 'lower(text)')} * 0.3::DOUBLE) AS score FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", sc.keyword_score(F.col("text")).alias("score"))


@q("subjective_flag", f"SELECT DISTINCT instruction_key, CASE WHEN instruction IS NOT NULL THEN {in_list(sc.SUBJECTIVE_WORDS, 'lower(instruction)')} > 0 END AS subjective FROM instructions")
def _(t: Tables):
    return t.instructions.select("instruction_key", sc.any_word(F.col("instruction"), sc.SUBJECTIVE_WORDS).alias("subjective")).distinct()


RETRY = " OR ".join([f"{in_list(sc.RETRY_TYPES, 'kind')} > 0", f"{in_list(sc.RETRY_MARKS, 'msg')} > 0"])
ERRORS = f"""SELECT DISTINCT {DOMAIN} AS domain, sample_id, calculated_at, CASE WHEN node_count % 3 = 0 THEN 'readtimeout' ELSE 'valueerror' END AS kind, lower(coalesce(error, 'http ' || element_count)) AS msg FROM sample_meta"""


@q("retry_classifier_F12", f"WITH e AS ({ERRORS}) SELECT domain, sample_id, calculated_at, coalesce({RETRY}, false) AS retry, {in_list(sc.TIMEOUT_MARKS, 'msg')} > 0 AS timeout FROM e")
def _(t: Tables):
    """F12 and F13 over error texts made from the sample table."""
    kind = F.when(F.col("node_count") % 3 == 0, "ReadTimeout").otherwise("ValueError")
    msg = F.coalesce("error", F.concat(F.lit("HTTP "), "element_count"))
    return t.sample_meta.select(folded(F.col("domain")).alias("domain"), "sample_id", "calculated_at", sc.retryable(kind, msg).alias("retry"), sc.is_timeout(msg).alias("timeout")).distinct()


@q("limit_per_domain_F14", f"""WITH d AS (SELECT DISTINCT {DOMAIN} AS domain, sample_id, diagram_id FROM diagrams) SELECT domain, sample_id, diagram_id FROM d QUALIFY row_number() OVER (PARTITION BY domain ORDER BY sample_id, diagram_id) <= 10""")
def _(t: Tables):
    d = t.diagrams.select(folded(F.col("domain")).alias("domain"), "sample_id", "diagram_id").distinct()
    return d.withColumn("n", F.row_number().over(Window.partitionBy("domain").orderBy("sample_id", "diagram_id"))).where("n <= 10").drop("n")


@q("missing_report", """SELECT * FROM (SELECT unnest(['xml_token_count', 'image_hash_md5', 'paper_id', 'error']) AS name, unnest([count(*) - count(xml_token_count), count(*) - count(image_hash_md5), count(*) - count(paper_id), count(*) - count(error)]) AS missing FROM sample_meta) WHERE missing > 0""")
def _(t: Tables):
    """missing values per column, most first."""
    names = ["xml_token_count", "image_hash_md5", "paper_id", "error"]
    one = t.sample_meta.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names])
    return one.unpivot([], names, "name", "missing").where("missing > 0").orderBy(F.desc("missing"), "name")
