"""Joins (J*), set operations (U1-U6), the results store (I*) and repair (D*) as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..functions.metrics import answer_correct, reply_for
from ..functions.paths import short_name
from ..functions.text import folded
from ..operators import matching, quality, ranking, store
from .registry import Catalogue, Tables
from .stat_queries import TIERED, WIDE, tiered, wide
from .text_queries import DOMAIN

C = Catalogue()
q = C.query

SAMPLES = f"s AS (SELECT DISTINCT {DOMAIN} AS domain, sample_id FROM sample_meta)"
PAIRS = f"p AS (SELECT DISTINCT pair_id, {DOMAIN} AS domain, sample_id, split_part(generation_model, '/', -1) AS model, question, answer FROM qa_pairs)"


def samples(t: Tables):
    return t.sample_meta.select(folded(F.col("domain")).alias("domain"), "sample_id").distinct()


def pairs(t: Tables):
    return t.qa_pairs.select("pair_id", folded(F.col("domain")).alias("domain"), "sample_id", short_name(F.col("generation_model")).alias("model"), "question", "answer").distinct()


@q("left_join_tier", f"WITH {WIDE}, {TIERED}, {PAIRS} SELECT pair_id, p.domain, p.sample_id, difficulty_level FROM p LEFT JOIN tier USING (domain, sample_id)")
def _(t: Tables):
    """Scores with the tier of their sample; the side that is broadcast is left to its size."""
    return pairs(t).select("pair_id", "domain", "sample_id").join(tiered(t).select("domain", "sample_id", "difficulty_level"), ["domain", "sample_id"], "left").select("pair_id", "domain", "sample_id", "difficulty_level")


@q("instruction_tier_J2", f"WITH {WIDE}, {TIERED}, i AS (SELECT DISTINCT instruction_key, {DOMAIN} AS domain, sample_id FROM instructions) SELECT instruction_key, difficulty_level FROM i LEFT JOIN tier USING (domain, sample_id)")
def _(t: Tables):
    i = t.instructions.select("instruction_key", folded(F.col("domain")).alias("domain"), "sample_id").distinct()
    return i.join(tiered(t).select("domain", "sample_id", "difficulty_level"), ["domain", "sample_id"], "left").select("instruction_key", "difficulty_level")


@q("inner_join_means", f"WITH {WIDE}, {PAIRS}, a AS (SELECT model, avg(generation_time) AS m FROM wide GROUP BY model), b AS (SELECT model, avg(length(answer)) AS m FROM p GROUP BY model) SELECT model, round(a.m, 6) AS task1_mean, round(b.m, 6) AS task2_mean FROM a JOIN b USING (model)")
def _(t: Tables):
    """Means of two tasks side by side."""
    a = wide(t).groupBy("model").agg(F.round(F.avg("generation_time"), 6).alias("task1_mean"))
    b = pairs(t).groupBy("model").agg(F.round(F.avg(F.length("answer")), 6).alias("task2_mean"))
    return a.join(b, "model")


@q("hash_lookup_J4", f"""WITH h AS (SELECT lower(trim(image_hash_md5, E' \\t\\n\\r')) AS md5, min(sample_id) AS sample_id FROM sample_meta GROUP BY 1),
n AS (SELECT DISTINCT {DOMAIN} AS domain, sample_id AS image, lower(trim(image_hash_md5, E' \\t\\n\\r')) AS md5 FROM sample_meta WHERE image_hash_md5 IS NOT NULL)
SELECT domain, image, n.md5, h.sample_id AS known FROM n LEFT JOIN h USING (md5)""")
def _(t: Tables):
    """The known sample of an image with the same content; the others get new ids."""
    known = t.sample_meta.groupBy(folded(F.col("image_hash_md5")).alias("md5")).agg(F.min("sample_id").alias("known"))
    images = t.sample_meta.where("image_hash_md5 IS NOT NULL").select(folded(F.col("domain")).alias("domain"), F.col("sample_id").alias("image"), folded(F.col("image_hash_md5")).alias("md5")).distinct()
    return images.join(known, "md5", "left").select("domain", "image", "md5", "known")


@q("score_lookup_J5_J19", f"WITH {WIDE}, {SAMPLES} SELECT s.domain, s.sample_id, model, execution_success_rate, xml_token_count FROM s LEFT JOIN wide USING (domain, sample_id)")
def _(t: Tables):
    return samples(t).join(wide(t).select("domain", "sample_id", "model", "execution_success_rate", "xml_token_count"), ["domain", "sample_id"], "left")


@q("metric_inputs_J6", f"""WITH {SAMPLES}, x AS (SELECT {DOMAIN} AS domain, sample_id, max(length(xml_content)) AS xml_length FROM diagrams GROUP BY ALL), y AS (SELECT {DOMAIN} AS domain, sample_id, count(DISTINCT pair_id) AS questions FROM qa_pairs GROUP BY ALL)
SELECT domain, sample_id, xml_length, coalesce(questions, 0) AS questions, x.sample_id IS NOT NULL AS rendered FROM s LEFT JOIN x USING (domain, sample_id) LEFT JOIN y USING (domain, sample_id)""")
def _(t: Tables):
    key = [folded(F.col("domain")).alias("domain"), "sample_id"]
    x = t.diagrams.groupBy(*key).agg(F.max(F.length("xml_content")).alias("xml_length"), F.lit(True).alias("r"))
    y = t.qa_pairs.groupBy(*key).agg(F.countDistinct("pair_id").alias("questions"))
    j = samples(t).join(x, ["domain", "sample_id"], "left").join(y, ["domain", "sample_id"], "left")
    return j.select("domain", "sample_id", "xml_length", F.coalesce("questions", F.lit(0)).alias("questions"), F.coalesce("r", F.lit(False)).alias("rendered"))


@q("preferred_fallback_J7", f"WITH {PAIRS} SELECT domain, sample_id, model FROM (SELECT DISTINCT domain, sample_id, model FROM p) QUALIFY row_number() OVER (PARTITION BY domain, sample_id ORDER BY model = 'vista-2' DESC, contains(model, 'vista') DESC, model) = 1")
def _(t: Tables):
    """The wanted model, else the first that has its family's name, else the first."""
    m = pairs(t).select("domain", "sample_id", "model").distinct()
    wanted = F.when(F.col("model") == "vista-2", 2).when(F.contains("model", F.lit("vista")), 1).otherwise(0)
    return ranking.first_preferred(m, ["domain", "sample_id"], wanted, "model")


@q("anti_done", f"WITH {SAMPLES}, d AS (SELECT DISTINCT {DOMAIN} AS domain, sample_id FROM diagrams) SELECT * FROM s ANTI JOIN d USING (domain, sample_id)")
def _(t: Tables):
    """J8."""
    return samples(t).join(t.diagrams.select(folded(F.col("domain")).alias("domain"), "sample_id"), ["domain", "sample_id"], "left_anti")


@q("retry_or_missing_J9_I7", f"""WITH {SAMPLES}, d AS (SELECT {DOMAIN} AS domain, sample_id, bool_or(NOT is_valid AND repair_attempts > 0) AS retry FROM diagrams GROUP BY ALL)
SELECT domain, sample_id FROM s LEFT JOIN d USING (domain, sample_id) WHERE d.sample_id IS NULL OR retry""")
def _(t: Tables):
    d = t.diagrams.groupBy(folded(F.col("domain")).alias("domain"), "sample_id").agg(F.bool_or(~F.col("is_valid") & (F.col("repair_attempts") > 0)).alias("retry"), F.lit(True).alias("done"))
    return samples(t).join(d, ["domain", "sample_id"], "left").where("done IS NULL OR retry").select("domain", "sample_id")


@q("semi_edited", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def _(t: Tables):
    """J10, F8."""
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@q("edited_pairs_F8_J10", f"WITH {PAIRS} SELECT pair_id FROM p WHERE EXISTS (SELECT 1 FROM diagrams d WHERE lower(trim(d.domain, E' \\t\\n\\r')) = p.domain AND d.sample_id = p.sample_id AND d.repair_attempts > 0)")
def _(t: Tables):
    edited = t.diagrams.where("repair_attempts > 0").select(folded(F.col("domain")).alias("domain"), "sample_id")
    return pairs(t).join(edited, ["domain", "sample_id"], "left_semi").select("pair_id")


@q("all_models_present", f"WITH {PAIRS} SELECT domain, sample_id FROM p WHERE model IN ('sketch-mini', 'sketch-large') GROUP BY ALL HAVING count(DISTINCT model) = 2")
def _(t: Tables):
    """Relational division."""
    return matching.having_all(pairs(t), ["domain", "sample_id"], "model", ["sketch-mini", "sketch-large"])


NAMES = "n AS (SELECT DISTINCT source AS name, regexp_replace(lower(source), '[^a-z0-9]', '', 'g') AS c FROM documents WHERE source IS NOT NULL), m AS (SELECT DISTINCT model_used AS name, regexp_replace(lower(split_part(model_used, '/', 1)), '[^a-z0-9]', '', 'g') AS c FROM diagrams)"
MODELS = "SELECT DISTINCT split_part(model_used, '/', -1) AS name FROM diagrams UNION SELECT DISTINCT split_part(model_used, '/', -1) || '_results' FROM diagrams UNION SELECT DISTINCT 'x_' || split_part(model_used, '/', -1) FROM diagrams"
CONTAINED = f"x AS (SELECT name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS c FROM ({MODELS})), y AS (SELECT l.name AS name_l, r.name AS name_r, l.c AS cl, r.c AS cr FROM x l JOIN x r ON contains(l.c, r.c) OR contains(r.c, l.c))"


def _names(t: Tables):
    m = t.diagrams.where("model_used IS NOT NULL").select(short_name(F.col("model_used")).alias("name")).distinct()
    return m.unionByName(m.select(F.concat("name", F.lit("_results")).alias("name"))).unionByName(m.select(F.concat(F.lit("x_"), "name").alias("name")))


@q("theta_name_match", f"WITH {CONTAINED} SELECT name_l, name_r FROM y")
def _(t: Tables):
    """Names that lie in one another."""
    n = _names(t)
    return matching.contained_names(n, n).select("name_l", "name_r")


@q("best_name_match", f"WITH {CONTAINED} SELECT name_l, name_r FROM y QUALIFY row_number() OVER (PARTITION BY name_l ORDER BY cl = cr DESC, (ends_with(cr, cl) OR ends_with(cl, cr)) DESC, name_r) = 1")
def _(t: Tables):
    """The best of them."""
    n = _names(t)
    return matching.best_names(n, n)


@q("reply_lookup_J14", f"WITH {PAIRS} SELECT pair_id, CASE WHEN pair_id % 3 = 0 THEN 'exact' WHEN pair_id % 3 = 1 THEN 'near' END AS reply FROM p WHERE question IS NOT NULL AND length(question) > 2")
def _(t: Tables):
    """The reply under the question, under a text around it, or none."""
    p = pairs(t).where("question IS NOT NULL AND length(question) > 2")
    key = F.when(F.col("pair_id") % 3 == 0, F.col("question")).when(F.col("pair_id") % 3 == 1, F.concat(F.lit("Q: "), "question")).otherwise(F.lit("\x00"))
    value = F.when(F.col("pair_id") % 3 == 0, "exact").otherwise("near")
    return p.select("pair_id", reply_for(F.col("question"), F.create_map(key, value)).alias("reply"))


@q("greedy_match")
def _(t: Tables):
    """Operations of an instruction against its own in other order."""
    i = t.instructions.select("instruction_key", "atomic_operations").distinct()
    return matching.greedy_pairs(i.withColumn("turned", F.reverse("atomic_operations")), "instruction_key", "atomic_operations", "turned")


@q("image_metadata_J17", "SELECT DISTINCT description_id, d.sample_id || '.png' AS file, title FROM descriptions d")
def _(t: Tables):
    """Metadata by base name."""
    rows = t.descriptions.select("description_id", F.concat(F.lit("images/"), "sample_id", F.lit(".png")).alias("path"), "title").distinct()
    meta = rows.select("description_id", F.element_at(F.split("path", "/"), -1).alias("file"), "title")
    files = rows.select("description_id", F.element_at(F.split("path", "/"), -1).alias("file"))
    return files.join(meta, ["description_id", "file"], "left")


@q("coverage_J18_U4_D7", f"WITH {SAMPLES}, f AS (SELECT DISTINCT {DOMAIN} AS domain, sample_id FROM descriptions) SELECT s.domain, s.sample_id FROM s LEFT JOIN f USING (domain, sample_id) WHERE f.sample_id IS NULL")
def _(t: Tables):
    """Samples that the other table lacks, by the full key."""
    return quality.missing_rows(samples(t), t.descriptions.select(folded(F.col("domain")).alias("domain"), "sample_id"), ["domain", "sample_id"])


@q("text_fallback_J21", "SELECT DISTINCT i.instruction_key, coalesce(nullif(i.note, ''), i.instruction) AS text FROM instructions i")
def _(t: Tables):
    i = t.instructions.select("instruction_key", "note", "instruction").distinct()
    return i.select("instruction_key", "instruction").join(i.select("instruction_key", "note"), "instruction_key", "left").select("instruction_key", F.coalesce(F.nullif("note", F.lit("")), "instruction").alias("text")).distinct()


# --- sets ---------------------------------------------------------------------

OPS = """o AS (SELECT instruction_key, coalesce(list_sort(list_distinct(list_transform(atomic_operations, lambda x: split_part(x, ' ', 1)))), []) AS a, ['approve', 'check', 'notify'] AS b FROM (SELECT DISTINCT instruction_key, atomic_operations FROM instructions WHERE atomic_operations IS NOT NULL))"""


@q("id_set_diff", f"WITH {OPS} SELECT instruction_key, array_to_string(list_sort(list_intersect(a, b)), ',') AS common, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x)) || list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS changed, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS has_all FROM o")
def _(t: Tables):
    """U1-U3."""
    rows = t.instructions.where("atomic_operations IS NOT NULL").select("instruction_key", "atomic_operations").distinct()
    a = F.array_distinct(F.transform("atomic_operations", lambda x: F.get(F.split(x, " "), F.lit(0))))
    b = F.array(*[F.lit(x) for x in ("approve", "check", "notify")])
    changed = F.array_union(F.array_except(a, b), F.array_except(b, a))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return rows.select("instruction_key", joined(F.array_intersect(a, b)).alias("common"), joined(changed).alias("changed"), (F.size(F.array_except(b, a)) == 0).alias("has_all"))


@q("union_distinct_U5", "SELECT sample_id FROM diagrams UNION SELECT sample_id FROM descriptions")
def _(t: Tables):
    return t.diagrams.select("sample_id").union(t.descriptions.select("sample_id")).distinct()


@q("replace_results_U6_K8", f"WITH {WIDE} SELECT diagram_id, CASE WHEN diagram_id % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM wide")
def _(t: Tables):
    old = wide(t).select("diagram_id", F.lit("old").alias("version"))
    return store.upsert(old, old.where("diagram_id % 3 = 0").withColumn("version", F.lit("new")), ["diagram_id"])


# --- store --------------------------------------------------------------------


@q("merge_latest", "SELECT event_type, user_id, arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def _(t: Tables):
    """The last write per key."""
    return store.latest(t.events, ["event_type", "user_id"], ["ts", "event_id"], ["value", "event_id"])


@q("upsert_metric_map_I1", "SELECT user_id, array_to_string(list_sort(list(event_type || '=' || CASE WHEN newest % 2 = 0 THEN 'new' ELSE 'old' END)), ',') AS metrics FROM (SELECT user_id, event_type, max(event_id) AS newest FROM events GROUP BY ALL) GROUP BY user_id")
def _(t: Tables):
    """Two documents of metrics per user merged: entries of the newer win, others stay."""
    e = t.events.groupBy("user_id", "event_type").agg(F.max("event_id").alias("newest"))
    doc = lambda rows, v: rows.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.lit(v)))).alias("m"))
    merged = store.merge_metric_maps(doc(e, 0.0), doc(e.where("newest % 2 = 0"), 1.0), ["user_id"], "m")
    shown = F.transform(F.map_entries("m"), lambda x: F.concat(x["key"], F.lit("="), F.when(x["value"] == 1.0, "new").otherwise("old")))
    return merged.select("user_id", F.array_join(F.array_sort(shown), ",").alias("metrics"))


SCORES = "sc AS (SELECT user_id, event_type AS metric, arg_max(value, (ts, event_id)) AS score, arg_max(event_id, (ts, event_id)) % 4 != 0 AS success FROM events GROUP BY ALL)"


def scores(t: Tables):
    e = store.latest(t.events, ["user_id", "event_type"], ["ts", "event_id"], ["value", "event_id"])
    return e.select("user_id", F.col("event_type").alias("metric"), F.col("value").alias("score"), (F.col("event_id") % 4 != 0).alias("success"))


ENABLED = ["click", "view", "error"]


@q("complete_keys_I3", f"WITH {SCORES} SELECT user_id FROM sc WHERE metric IN ('click', 'view', 'error') AND score IS NOT NULL AND success GROUP BY user_id HAVING count(DISTINCT metric) = 3")
def _(t: Tables):
    return store.complete_keys(scores(t), ["user_id"], ENABLED)


@q("incremental_todo", f"WITH {SCORES} SELECT u.user_id, m.metric FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest(['click', 'view', 'error']) AS metric) m WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.user_id = u.user_id AND sc.metric = m.metric AND score IS NOT NULL AND success)")
def _(t: Tables):
    """I4."""
    return store.still_to_do(t.events, scores(t), ["user_id"], ENABLED)


@q("wide_table_K7", f"WITH {SCORES} SELECT user_id, max(score) FILTER (metric = 'click') AS click, max(score) FILTER (metric = 'view') AS view, max(score) FILTER (metric = 'error') AS error FROM sc GROUP BY user_id")
def _(t: Tables):
    """The wide table, whatever the success of a cell."""
    return store.wide(scores(t), ["user_id"], ENABLED)


@q("early_exit_I6", "SELECT DISTINCT diagram_id, metric, CASE WHEN xml_content IS NULL THEN 0.0::DOUBLE WHEN metric = 'tokens' THEN (length(xml_content) // 4)::DOUBLE ELSE 1.0::DOUBLE END AS score, xml_content IS NOT NULL AS success FROM diagrams, (SELECT unnest(['tokens', 'exists']) AS metric)")
def _(t: Tables):
    """Without an output every enabled metric is 0 and failed."""
    gone = F.col("xml_content").isNull()
    cell = lambda n, v: F.struct(F.lit(n).alias("metric"), F.when(gone, 0.0).otherwise(v).alias("score"), (~gone).alias("success"))
    rows = t.diagrams.select("diagram_id", F.explode(F.array(cell("tokens", F.floor(F.length("xml_content") / 4).cast("double")), cell("exists", F.lit(1.0)))).alias("c"))
    return rows.select("diagram_id", "c.*").distinct()


@q("latest_status_I8_I9", "SELECT user_id, count(*) AS history, arg_max(event_type, (ts, event_id)) AS latest FROM events GROUP BY user_id")
def _(t: Tables):
    """An append-only log and its latest entry."""
    return t.events.groupBy("user_id").agg(F.count("*").alias("history"), F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))


@q("evaluate_registry_I5_M31", "SELECT DISTINCT diagram_id, metric, CASE WHEN metric = 'xml_token_count' THEN greatest(1, length(xml_content) // 4)::DOUBLE WHEN xml_content IS NULL THEN 0.0::DOUBLE WHEN is_valid THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, CASE WHEN metric = 'xml_token_count' THEN xml_content IS NOT NULL ELSE true END AS success FROM diagrams, (SELECT unnest(['execution_success_rate', 'xml_token_count']) AS metric)")
def _(t: Tables):
    """All enabled metrics of the registry in one pass."""
    from ..functions.metrics import default_registry

    rows = t.diagrams.select("diagram_id", F.col("xml_content").alias("xml"), F.coalesce("is_valid", F.lit(False)).alias("rendered"))  # no other metric has its input here
    out = default_registry().evaluate(rows, ["diagram_id"])
    missing = (F.col("metric") == "xml_token_count") & ~F.col("success")
    return out.withColumn("score", F.when(missing, F.lit(None)).otherwise(F.col("score"))).distinct()


@q("evaluate_all_I5", """WITH e AS (SELECT event_id AS id, event_id % 3 AS r, event_id % 5 AS v FROM events)
SELECT id, metric, CASE metric WHEN 'execution_success_rate' THEN CASE WHEN r = 0 THEN 0 ELSE 1 END WHEN 'xml_token_count' THEN length('<a>12345</a>') // 4 WHEN 'style_consistency_score' THEN v / 10.0 WHEN 'codevqa' THEN r / 3.0 WHEN 'siglip_score' THEN round(1 / sqrt(1.0 + v * v), 9)
  WHEN 'modified_xml_execution_success_rate' THEN CASE WHEN r = 0 THEN 0 ELSE 1 END WHEN 'modified_xml_token_count' THEN length('<a>12345</a>') // 4 WHEN 'modification_json_token_count' THEN 3 WHEN 'style_consistency_score_task2' THEN v / 10.0 WHEN 'xdrfr' THEN (3 - r) / 3.0 WHEN 'xml_edit_distance' THEN CASE WHEN v = 0 THEN 0 ELSE 0.5 END END::DOUBLE AS score
FROM e, (SELECT unnest(['execution_success_rate', 'xml_token_count', 'style_consistency_score', 'codevqa', 'siglip_score', 'modified_xml_execution_success_rate', 'modified_xml_token_count', 'modification_json_token_count', 'style_consistency_score_task2', 'xdrfr', 'xml_edit_distance']) AS metric)""")
def _(t: Tables):
    """All eleven metrics of both tasks in one pass, on inputs made from the id."""
    from ..functions.metrics import default_registry

    r, v = F.col("event_id") % 3, F.col("event_id") % 5
    right = lambda n: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: i < n)
    judged = F.concat(F.lit('{"final_score": '), (v / 10).cast("string"), F.lit("}"))
    rows = t.events.select(
        F.col("event_id").alias("id"), F.lit("<a>12345</a>").alias("xml"), (r != 0).alias("rendered"), judged.alias("style_reply"), right(r).alias("answers_right"), F.array(F.lit(1.0), v.cast("double")).alias("image_vector"), F.array(F.lit(1.0), F.lit(0.0)).alias("render_vector"),
        F.lit("<a>12345</a>").alias("modified_xml"), (r != 0).alias("modified_rendered"), F.lit('[{"a": "b"}]').alias("changes_json"), judged.alias("style_reply_task2"), right(3 - r).alias("satisfied"),
        F.lit("one two").alias("xml_before"), F.when(v == 0, "one two").otherwise("one 2").alias("xml_after"),
    )
    return default_registry().evaluate(rows, ["id"]).select("id", "metric", F.when(F.col("metric") == "siglip_score", F.round("score", 9)).otherwise(F.col("score")).alias("score"))


# --- quality ------------------------------------------------------------------

PATH = "CASE WHEN repair_attempts = 3 THEN 'out/domain_other/' ELSE 'out/' || domain || '/' END || sample_id || '/x.png'"


def _with_path(t: Tables):
    w = wide(t)
    return w.withColumn("path", F.concat(F.when(F.col("repair_attempts") == 3, F.lit("out/domain_other/")).otherwise(F.concat(F.lit("out/"), "domain", F.lit("/"))), "sample_id", F.lit("/x.png")))


@q("corruption_report", f"WITH {WIDE}, b AS (SELECT model, domain, coalesce(regexp_extract({PATH}, '(?:^|/)(domain_[^/]*)', 1) != domain, false) AS bad FROM wide) SELECT model, domain, count(*) AS total, count(*) FILTER (bad) AS corrupted, round(100.0 * count(*) FILTER (bad) / count(*), 6) AS rate FROM b GROUP BY ROLLUP (model, domain)")
def _(t: Tables):
    """D1, A22."""
    rows = _with_path(t)
    return quality.corruption_report(rows, "model", "domain", quality.corrupted(F.col("domain"), F.col("path"))).withColumn("rate", F.round("rate", 6))


@q("clear_corrupted_D2", f"WITH {WIDE} SELECT diagram_id, CASE WHEN repair_attempts = 3 THEN 0 ELSE 1 END::BIGINT AS metrics FROM wide")
def _(t: Tables):
    m = quality.clear_if_corrupted(F.create_map(F.lit("m"), F.lit(1.0)), F.col("domain"), F.col("sample_id"), F.col("path"))
    return _with_path(t).select("diagram_id", F.size(m).alias("metrics"))


@q("failed_zero_to_null", f"WITH {WIDE} SELECT diagram_id, CASE WHEN NOT coalesce(is_valid, true) AND repair_attempts = 0 THEN NULL ELSE repair_attempts END::BIGINT AS score FROM wide")
def _(t: Tables):
    """D3."""
    return wide(t).select("diagram_id", quality.failed_zero_to_null(F.col("repair_attempts"), F.col("is_valid")).alias("score"))


@q("cleanup_counts_A23", f"WITH {WIDE} SELECT domain, count(*) AS rows, count(*) FILTER (NOT coalesce(is_valid, true) AND repair_attempts = 0) AS cleaned FROM wide GROUP BY domain")
def _(t: Tables):
    cleaned = F.col("repair_attempts").isNotNull() & quality.failed_zero_to_null(F.col("repair_attempts"), F.col("is_valid")).isNull()
    return wide(t).groupBy("domain").agg(F.count("*").alias("rows"), F.count_if(cleaned).alias("cleaned"))


@q("zero_to_null", f"WITH {WIDE} SELECT diagram_id, nullif(repair_attempts, 0)::BIGINT AS score, CASE WHEN repair_attempts = 0 THEN false ELSE coalesce(is_valid, true) END AS success FROM wide")
def _(t: Tables):
    """D4."""
    score, success = quality.zero_is_failure(F.col("repair_attempts"), F.col("is_valid"))
    return wide(t).select("diagram_id", score.alias("score"), success.alias("success"))


@q("fill_level_D5", "SELECT DISTINCT instruction_key, CASE WHEN coalesce(difficulty_level, 'unknown') = 'unknown' THEN upper(split_part(instruction_id, '_', 2)[1:1]) || split_part(instruction_id, '_', 2)[2:] ELSE difficulty_level END AS level FROM instructions")
def _(t: Tables):
    return t.instructions.select("instruction_key", quality.fill_level(F.col("difficulty_level"), sc.level_from_id(F.col("instruction_id"))).alias("level")).distinct()


@q("path_repair_D6", f"WITH {WIDE} SELECT diagram_id, domain || '/' || sample_id || '/x.png' AS path FROM wide")
def _(t: Tables):
    from ..functions.paths import relative

    absolute = F.concat(F.lit("/home/x/out/"), "domain", F.lit("/"), "sample_id", F.lit("/x.png"))
    return wide(t).select("diagram_id", relative(absolute, "benchmark").alias("path"))


# --- answers ------------------------------------------------------------------


@q("counting_answer_M11", r"""WITH p AS (SELECT DISTINCT pair_id, regexp_replace(lower(trim(answer)), '[^\p{L}\p{M}\p{N}_\s\p{Z}]', '', 'g') AS a FROM qa_pairs WHERE lower(trim(question_type)) = 'counting' AND answer IS NOT NULL)
SELECT pair_id, CASE WHEN regexp_extract(a, '\p{Nd}+') != '' THEN regexp_extract(a, '\p{Nd}+') = (pair_id % 20)::VARCHAR ELSE regexp_replace(a, '[\s\p{Z}]+', ' ', 'g') = (pair_id % 20)::VARCHAR END AS correct FROM p""")
def _(t: Tables):
    """The counting rule on all answers, in any letters, against a number made from the id."""
    from ..functions.metrics import counting_correct

    p = t.qa_pairs.where("lower(trim(question_type)) = 'counting' AND answer IS NOT NULL").select("pair_id", "answer").distinct()
    return p.select("pair_id", counting_correct(F.col("answer"), (F.col("pair_id") % 20).cast("string")).alias("correct"))


@q("answer_cascade")
def _(t: Tables):
    """Every answer against the anchor, by the whole cascade."""
    p = t.qa_pairs.select("pair_id", "answer", "visual_anchor", F.lower(F.trim("question_type")).alias("kind")).distinct()
    return p.select("pair_id", answer_correct("answer", "visual_anchor", "kind").alias("correct"))


@q("accuracy_of_answers_A3")
def _(t: Tables):
    """Right answers by kind of question, by the cascade, against the anchor; total, correct, share of four and per cent of two digits."""
    p = t.qa_pairs.select("pair_id", "answer", "visual_anchor", F.lower(F.trim("question_type")).alias("kind")).distinct()
    right = F.count_if(answer_correct("answer", "visual_anchor", "kind"))
    out = p.groupBy("kind").agg(F.count("*").alias("total"), right.alias("correct")).where("kind IS NOT NULL")
    return out.withColumn("accuracy", F.round(F.col("correct") / F.col("total"), 4)).withColumn("percent", F.round(F.col("correct") * 100.0 / F.col("total"), 2))


@q("score_cache_I10", f"WITH {WIDE} SELECT domain, model, count(*) AS scores FROM wide WHERE model IS NOT NULL AND domain IS NOT NULL GROUP BY ALL")
def _(t: Tables):
    """Scores of a (model, domain) are computed once and read from the cache afterwards."""
    rows = wide(t).where("model IS NOT NULL AND domain IS NOT NULL")
    cache = store.ScoreCache(rows, ["model", "domain"])
    scores = cache.get()
    return scores.groupBy("domain", "model").agg(F.count("*").alias("scores"))


@q("yes_no_normalise", "SELECT DISTINCT pair_id, CASE WHEN lower(trim(answer)) IN ('yes', 'true', '1', '是') THEN 'Yes' ELSE 'No' END AS reply FROM qa_pairs")
def _(t: Tables):
    """M19."""
    return t.qa_pairs.select("pair_id", sc.yes_no(F.col("answer")).alias("reply")).distinct()
