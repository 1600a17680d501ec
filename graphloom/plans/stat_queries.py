"""Aggregations (A*), ranking (W*) and sampling (U7, U8) as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..functions.paths import short_name
from ..functions.text import folded
from ..operators import ranking, stats
from .registry import Catalogue, Tables
from .text_queries import DOMAIN

C = Catalogue()
q = C.query

#: The wide score table of the first task: one row per diagram.
WIDE = f"""wide AS (SELECT DISTINCT diagram_id, {DOMAIN} AS domain, sample_id, split_part(model_used, '/', -1) AS model,
  greatest(1, length(xml_content) // 4)::DOUBLE AS xml_token_count, CASE WHEN is_valid THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS execution_success_rate, generation_time, repair_attempts, is_valid FROM diagrams)"""


def wide(t: Tables):
    return t.diagrams.select(
        "diagram_id", folded(F.col("domain")).alias("domain"), "sample_id", short_name(F.col("model_used")).alias("model"),
        sc.token_estimate(F.col("xml_content")).cast("double").alias("xml_token_count"),
        F.when(F.col("is_valid"), 1.0).otherwise(0.0).alias("execution_success_rate"), "generation_time", "repair_attempts", "is_valid",
    ).distinct()


def six_sql(c: str, digits: int = 6) -> str:
    """The SQL of ``six_numbers``."""
    calls = {"mean": "avg({})", "median": "quantile_cont({}, 0.5)", "std": "stddev_samp({})", "min": "min({})::DOUBLE", "max": "max({})::DOUBLE"}
    return ", ".join([f"round({f.format(c)}, {digits}) AS {c}_{k}" for k, f in calls.items()] + [f"count({c}) AS {c}_count"])


METRICS = ["xml_token_count", "execution_success_rate", "generation_time"]


@q("summary_by_model", f"WITH {WIDE} SELECT model, {', '.join(six_sql(m, 3) for m in METRICS)} FROM wide WHERE model IS NOT NULL GROUP BY model")
def _(t: Tables):
    """A1: six numbers of every metric per model."""
    return stats.summary(wide(t), ["model"], METRICS, 3)


@q("stats_nullsafe_by_model", f"WITH {WIDE} SELECT model, {six_sql('generation_time')}, count(*) AS valid_samples_count FROM wide WHERE model IS NOT NULL GROUP BY model")
def _(t: Tables):
    """A5: rounded to six decimals, so that two engines can be compared."""
    return stats.summary(wide(t), ["model"], ["generation_time"], 6, "valid_samples_count")


TIERED = """q AS (SELECT quantile_cont(xml_token_count, 0.33) AS q33 FROM wide WHERE xml_token_count IS NOT NULL),
tier AS (SELECT wide.*, CASE WHEN xml_token_count < q33 THEN 'Easy' WHEN xml_token_count < 14000 THEN 'Medium' WHEN xml_token_count IS NOT NULL THEN 'Hard' END AS difficulty_level FROM wide, q)"""


def tiered(t: Tables):
    w = wide(t)
    low = w.agg(F.percentile("xml_token_count", 0.33).alias("q33"))
    return w.crossJoin(F.broadcast(low)).withColumn("difficulty_level", sc.token_tier(F.col("xml_token_count"), F.col("q33"))).drop("q33")


@q("stats_by_difficulty", f"WITH {WIDE}, {TIERED} SELECT difficulty_level, model, {six_sql('generation_time')}, count(*) AS rows FROM tier WHERE difficulty_level IS NOT NULL AND model IS NOT NULL GROUP BY ALL")
def _(t: Tables):
    """Per difficulty and model."""
    return stats.summary(tiered(t), ["difficulty_level", "model"], ["generation_time"], 6, "rows")


@q("tier_assign", f"WITH {WIDE}, {TIERED} SELECT diagram_id, difficulty_level FROM tier")
def _(t: Tables):
    """P18."""
    return tiered(t).select("diagram_id", "difficulty_level")


@q("tier_crosstab", f"WITH {WIDE}, {TIERED} SELECT domain, count(*) FILTER (difficulty_level = 'Easy') AS Easy, count(*) FILTER (difficulty_level = 'Medium') AS Medium, count(*) FILTER (difficulty_level = 'Hard') AS Hard FROM tier GROUP BY domain")
def _(t: Tables):
    """A14."""
    return stats.cross_tab(tiered(t), "domain", "difficulty_level", ["Easy", "Medium", "Hard"])


@q("tier_thresholds", f"WITH {WIDE} SELECT " + ", ".join(f"round(quantile_cont(xml_token_count, {p}), 6) AS q{n}" for n, p in (("25", .25), ("33", .33), ("50", .5), ("66", .66), ("75", .75))) + " FROM wide")
def _(t: Tables):
    """A9."""
    return wide(t).agg(*[F.round(c, 6).alias(n) for n, c in (("q25", F.percentile("xml_token_count", 0.25)), ("q33", F.percentile("xml_token_count", 0.33)), ("q50", F.percentile("xml_token_count", 0.5)), ("q66", F.percentile("xml_token_count", 0.66)), ("q75", F.percentile("xml_token_count", 0.75)))])


@q("token_stats_grouping_sets", f"WITH {WIDE} SELECT coalesce(domain, 'all') AS domain, round(avg(xml_token_count), 6) AS mean, round(stddev_samp(xml_token_count), 6) AS std, min(xml_token_count) AS min, max(xml_token_count) AS max, round(quantile_cont(xml_token_count, 0.25), 6) AS q25, round(quantile_cont(xml_token_count, 0.5), 6) AS q50, round(quantile_cont(xml_token_count, 0.75), 6) AS q75 FROM wide GROUP BY GROUPING SETS ((), (domain))")
def _(t: Tables):
    """All rows and each domain in one pass."""
    v = F.col("xml_token_count")
    r = lambda c: F.round(c, 6)
    g = wide(t).rollup("domain").agg(r(F.avg(v)).alias("mean"), r(F.stddev_samp(v)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), *[r(F.percentile(v, p)).alias(n) for n, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))])
    return g.withColumn("domain", F.coalesce("domain", F.lit("all")))


LEVEL = "lower(split_part(instruction_id, '_', 2))"


@q("level_mean_count", f"WITH i AS (SELECT DISTINCT instruction_key, instruction_id, author, atomic_operation_count AS n FROM instructions) SELECT {LEVEL} AS level, n % 2 = 0 AS even, round(avg(n), 3) AS mean, count(n) AS n FROM i WHERE n IS NOT NULL GROUP BY ALL")
def _(t: Tables):
    """A2: mean and count by two keys, NULL keys dropped."""
    i = t.instructions.select("instruction_key", F.lower(F.get(F.split("instruction_id", "_"), F.lit(1))).alias("level"), F.col("atomic_operation_count").alias("n")).distinct()
    return i.where("n IS NOT NULL").groupBy("level", (F.col("n") % 2 == 0).alias("even")).agg(F.round(F.avg("n"), 3).alias("mean"), F.count("n").alias("n"))


QA = "qa AS (SELECT DISTINCT pair_id, lower(trim(question_type)) AS kind, split_part(generation_model, '/', -1) AS model, coalesce(length(trim(answer)), 0) > 20 AS correct FROM qa_pairs)"


def qa(t: Tables):
    return t.qa_pairs.select("pair_id", F.lower(F.trim("question_type")).alias("kind"), short_name(F.col("generation_model")).alias("model"), (F.coalesce(F.length(F.trim("answer")), F.lit(0)) > 20).alias("correct")).distinct()


@q("accuracy_by_type", f"WITH {QA} SELECT model, kind, count(*) AS total, count(*) FILTER (correct) AS correct, round(count(*) FILTER (correct) / count(*), 4) AS accuracy, round(100.0 * count(*) FILTER (correct) / count(*), 2) AS percent FROM qa WHERE kind IS NOT NULL GROUP BY ALL")
def _(t: Tables):
    """A3; a long answer stands for a right one."""
    right = F.count_if("correct")
    return qa(t).where("kind IS NOT NULL").groupBy("model", "kind").agg(F.count("*").alias("total"), right.alias("correct"), F.round(right / F.count("*"), 4).alias("accuracy"), F.round(right * 100.0 / F.count("*"), 2).alias("percent"))


@q("dim_unpivot_stats", """SELECT dimension, round(avg(v), 2) AS mean, round(coalesce(stddev_samp(v), 0), 2) AS std, min(v) AS min, max(v) AS max, count(v) AS n
FROM (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS dimension, unnest([l_quantity, l_discount, l_tax]) AS v FROM lineitem) GROUP BY dimension""")
def _(t: Tables):
    """A4."""
    return stats.dimension_stats(t.lineitem, ["l_quantity", "l_discount", "l_tax"])


@q("stats_by_level_A7", f"WITH i AS (SELECT DISTINCT instruction_key, {LEVEL} AS level, author, atomic_operation_count FROM instructions) SELECT level, {six_sql('atomic_operation_count')} FROM i WHERE level IS NOT NULL GROUP BY level")
def _(t: Tables):
    i = t.instructions.select("instruction_key", F.lower(F.get(F.split("instruction_id", "_"), F.lit(1))).alias("level"), "atomic_operation_count").distinct()
    return stats.summary(i, ["level"], ["atomic_operation_count"], 6)


STATUS = "CASE WHEN is_valid IS NULL THEN 'pending' WHEN is_valid THEN 'success' ELSE 'failed' END"


@q("status_by_model", f"WITH {WIDE} SELECT model, count(*) FILTER ({STATUS} = 'success') AS success, count(*) FILTER ({STATUS} = 'failed') AS failed, count(*) FILTER ({STATUS} = 'pending') AS pending FROM wide GROUP BY model")
def _(t: Tables):
    """A10."""
    status = F.when(F.col("is_valid").isNull(), "pending").when(F.col("is_valid"), "success").otherwise("failed")
    return stats.cross_tab(wide(t).withColumn("status", status), "model", "status", ["success", "failed", "pending"])


@q("count_by_domain_A11", f"SELECT domain, count(*) AS n FROM (SELECT DISTINCT {DOMAIN} AS domain, sample_id FROM sample_meta) GROUP BY domain")
def _(t: Tables):
    return t.sample_meta.select(folded(F.col("domain")).alias("domain"), "sample_id").distinct().groupBy("domain").agg(F.count("*").alias("n"))


@q("success_rate_by_domain", f"WITH {WIDE} SELECT domain, count(*) FILTER (is_valid) AS successes, count(*) FILTER (NOT is_valid) AS failures, round(coalesce(100.0 * count(*) FILTER (is_valid) / nullif(count(*) FILTER (is_valid) + count(*) FILTER (NOT is_valid), 0), 0), 6) AS rate FROM wide GROUP BY domain")
def _(t: Tables):
    """A12."""
    return stats.success_rates(wide(t), ["domain"], F.col("is_valid")).withColumn("rate", F.round("rate", 6))


@q("value_share", f"WITH d AS (SELECT DISTINCT diagram_id, lower(trim(diagram_type)) AS kind FROM diagrams) SELECT kind, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM d WHERE kind IS NOT NULL GROUP BY kind")
def _(t: Tables):
    """A13."""
    d = t.diagrams.select("diagram_id", F.lower(F.trim("diagram_type")).alias("kind")).distinct()
    return stats.shares(d, "kind").withColumn("percent", F.round("percent", 6))


@q("histogram_50", """WITH e AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi, count(n_chars) AS total FROM documents)
SELECT least(floor((n_chars - lo) / ((hi - lo) / 50)), 49)::BIGINT AS bin, round(lo + least(floor((n_chars - lo) / ((hi - lo) / 50)), 49) * ((hi - lo) / 50), 6) AS low, count(*) AS n, round(count(*) / (total * ((hi - lo) / 50)), 9) AS density FROM documents, e GROUP BY 1, 2, total, lo, hi""")
def _(t: Tables):
    """The histogram."""
    return stats.histogram(t.documents, "n_chars", 50).withColumn("low", F.round("low", 6)).withColumn("density", F.round("density", 9))


@q("boxplot_five", "SELECT domain, min(n_chars)::DOUBLE AS low, round(quantile_cont(n_chars, 0.25), 6) AS q25, round(quantile_cont(n_chars, 0.5), 6) AS mid, round(quantile_cont(n_chars, 0.75), 6) AS q75, max(n_chars)::DOUBLE AS high FROM documents GROUP BY domain")
def _(t: Tables):
    """Box-plot numbers."""
    return t.documents.groupBy("domain").agg(F.min("n_chars").cast("double").alias("low"), *[F.round(F.percentile("n_chars", p), 6).alias(n) for n, p in (("q25", 0.25), ("mid", 0.5), ("q75", 0.75))], F.max("n_chars").cast("double").alias("high"))


@q("density_estimate_A15", """WITH e AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi, stddev_samp(n_chars) * pow(count(*), -0.2) AS h, count(*) AS total FROM documents),
g AS (SELECT least(floor((n_chars - lo) / ((hi - lo) / 400)), 399) AS bin, count(*) AS n FROM documents, e GROUP BY 1),
m AS (SELECT lo + (hi - lo) * i / 49.0 AS x FROM e, range(50) r(i))
SELECT round(x, 4) AS x, round(sum(n * exp(-pow((x - (lo + (bin + 0.5) * (hi - lo) / 400)) / h, 2) / 2)) / any_value(total * h * 2.5066282746310002), 9) AS density FROM m, g, e GROUP BY x""")
def _(t: Tables):
    return stats.density_estimate(t.documents, "n_chars").select(F.round("x", 4).alias("x"), F.round("density", 9).alias("density"))


@q("pivot_mean_A16", f"WITH {WIDE}, {TIERED} SELECT model, round(avg(generation_time) FILTER (difficulty_level = 'Easy'), 6) AS Easy, round(avg(generation_time) FILTER (difficulty_level = 'Medium'), 6) AS Medium, round(avg(generation_time) FILTER (difficulty_level = 'Hard'), 6) AS Hard FROM tier GROUP BY model")
def _(t: Tables):
    p = tiered(t).groupBy("model").pivot("difficulty_level", ["Easy", "Medium", "Hard"]).agg(F.avg("generation_time"))
    return p.select("model", *[F.round(c, 6).alias(c) for c in ("Easy", "Medium", "Hard")])


@q("describe_A17", f"WITH {WIDE} SELECT {six_sql('xml_token_count')}, round(quantile_cont(xml_token_count, 0.25), 6) AS q25, round(quantile_cont(xml_token_count, 0.75), 6) AS q75 FROM wide")
def _(t: Tables):
    return wide(t).agg(*stats.six_numbers("xml_token_count", 6), F.round(F.percentile("xml_token_count", 0.25), 6).alias("q25"), F.round(F.percentile("xml_token_count", 0.75), 6).alias("q75"))


@q("model_statistics", f"WITH {WIDE} SELECT model, count(*) AS total, count(*) FILTER (is_valid) AS successes, round(sum(generation_time) FILTER (is_valid) / nullif(count(*) FILTER (is_valid), 0), 6) AS mean_time, round(100.0 * count(*) FILTER (is_valid) / count(*), 6) AS success_rate FROM wide GROUP BY model")
def _(t: Tables):
    """Averages over successes only."""
    ok = F.count_if("is_valid")
    return wide(t).groupBy("model").agg(F.count("*").alias("total"), ok.alias("successes"), F.round(F.try_divide(F.sum(F.when(F.col("is_valid"), F.col("generation_time"))), ok), 6).alias("mean_time"), F.round(ok * 100.0 / F.count("*"), 6).alias("success_rate"))


@q("merge_statistics_A19", f"WITH {WIDE}, o AS (SELECT model, count(*) AS total, max(generation_time) AS slowest FROM wide WHERE diagram_id % 2 = 0 GROUP BY model), n AS (SELECT model, count(*) AS total, max(generation_time) AS slowest FROM wide WHERE diagram_id % 3 = 0 GROUP BY model) SELECT model, greatest(o.total, n.total) AS total, coalesce(n.slowest, o.slowest) AS slowest FROM o FULL JOIN n USING (model)")
def _(t: Tables):
    w = wide(t)
    of = lambda c: w.where(c).groupBy("model").agg(F.count("*").alias("total"), F.max("generation_time").alias("slowest"))
    return stats.merge_statistics(of("diagram_id % 2 = 0"), of("diagram_id % 3 = 0"), "model", "total", ["slowest"])


@q("batch_summary_A20", f"WITH {WIDE} SELECT domain, count(*) AS total, count(*) FILTER (is_valid) AS valid, count(*) FILTER (repair_attempts > 0) AS repaired, count(*) FILTER (xml_token_count > 1) AS with_xml, count(*) FILTER (generation_time IS NULL) AS untimed FROM wide GROUP BY domain")
def _(t: Tables):
    return wide(t).groupBy("domain").agg(F.count("*").alias("total"), F.count_if("is_valid").alias("valid"), F.count_if(F.col("repair_attempts") > 0).alias("repaired"), F.count_if(F.col("xml_token_count") > 1).alias("with_xml"), F.count_if(F.col("generation_time").isNull()).alias("untimed"))


@q("status_counts", f"WITH {WIDE}, s AS (SELECT DISTINCT {DOMAIN} AS domain, sample_id FROM sample_meta) SELECT count(*) AS total, count(*) FILTER (is_valid) AS approved, count(*) FILTER (NOT is_valid) AS rejected, count(*) FILTER (is_valid IS NULL) AS pending FROM s LEFT JOIN wide USING (domain, sample_id)")
def _(t: Tables):
    """A sample without diagram is pending."""
    s = t.sample_meta.select(folded(F.col("domain")).alias("domain"), "sample_id").distinct().join(wide(t), ["domain", "sample_id"], "left")
    return s.agg(F.count("*").alias("total"), F.count_if("is_valid").alias("approved"), F.count_if(~F.col("is_valid")).alias("rejected"), F.count_if(F.col("is_valid").isNull()).alias("pending"))


@q("array_totals_A24", "WITH i AS (SELECT DISTINCT instruction_key, atomic_operations FROM instructions) SELECT count(*) AS instructions, sum(coalesce(len(atomic_operations), 0))::BIGINT AS operations FROM i")
def _(t: Tables):
    i = t.instructions.select("instruction_key", "atomic_operations").distinct()
    return i.agg(F.count("*").alias("instructions"), F.sum(F.greatest(F.size(F.coalesce("atomic_operations", F.array().cast("array<string>"))), F.lit(0))).alias("operations"))


@q("ratio_scores_A25", f"WITH {QA.replace('pair_id,', 'pair_id, sample_id, ' + DOMAIN + ' AS domain,')} SELECT domain, sample_id, round(count(*) FILTER (correct) / count(*), 6) AS score FROM qa GROUP BY ALL")
def _(t: Tables):
    rows = t.qa_pairs.select("pair_id", folded(F.col("domain")).alias("domain"), "sample_id", (F.coalesce(F.length(F.trim("answer")), F.lit(0)) > 20).alias("correct")).distinct()
    return rows.groupBy("domain", "sample_id").agg(F.round(F.try_divide(F.count_if("correct"), F.count("*")), 6).alias("score"))


@q("run_statistics_A26", f"WITH {WIDE} SELECT count(*) AS total, count(*) FILTER (is_valid) AS success, count(*) FILTER (NOT is_valid) AS failed, count(*) FILTER (xml_token_count = 1) AS skipped, array_to_string(list_sort(list(diagram_id) FILTER (NOT is_valid))[1:10], ',') AS first_errors FROM wide")
def _(t: Tables):
    """The ten smallest failed ids come from a top-n scan, not from a collected list."""
    w = wide(t)
    first = w.where("NOT is_valid").orderBy("diagram_id").limit(10).agg(F.array_join(F.array_sort(F.collect_list("diagram_id")).cast("array<string>"), ",").alias("first_errors"))
    return w.agg(F.count("*").alias("total"), F.count_if("is_valid").alias("success"), F.count_if(~F.col("is_valid")).alias("failed"), F.count_if(F.col("xml_token_count") == 1).alias("skipped")).crossJoin(first)


@q("domains_per_model_A27", f"WITH {WIDE} SELECT model, array_to_string(list_sort(list(DISTINCT domain)), ',') AS domains, count(DISTINCT (domain, sample_id)) AS samples FROM wide GROUP BY model")
def _(t: Tables):
    return wide(t).groupBy("model").agg(F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains"), F.countDistinct("domain", "sample_id").alias("samples"))


@q("viewer_totals_A29", f"SELECT count(DISTINCT ({DOMAIN}, sample_id)) AS samples, count(DISTINCT instruction_key) AS instructions FROM instructions")
def _(t: Tables):
    return t.instructions.agg(F.countDistinct(folded(F.col("domain")), "sample_id").alias("samples"), F.countDistinct("instruction_key").alias("instructions"))


# --- ranking ------------------------------------------------------------------


@q("screen_top_n", """WITH x AS (SELECT doc_id, n_chars AS score, n_chars >= 600 AS c FROM documents), b AS (SELECT doc_id FROM x ORDER BY score DESC, doc_id LIMIT 50), m AS (SELECT count(*) FILTER (c) > 50 AS many FROM x)
SELECT x.doc_id, CASE WHEN many THEN c AND b.doc_id IS NOT NULL ELSE c END AS is_candidate, CASE WHEN many AND c AND b.doc_id IS NULL THEN 'not among the best 50' END AS reason FROM x LEFT JOIN b ON x.doc_id = b.doc_id, m""")
def _(t: Tables):
    """W1."""
    rows = t.documents.select("doc_id", F.col("n_chars").alias("score"))
    return ranking.screen_top(rows, "score", F.col("score") >= 600, 50, "doc_id").select("doc_id", "is_candidate", "reason")


@q("sorted_keys_W2", f"WITH {WIDE} SELECT domain, sample_id, model FROM wide")
def _(t: Tables):
    return wide(t).select("domain", "sample_id", "model").orderBy("domain", "sample_id", "model")


@q("preferred_model_W3", f"WITH {WIDE} SELECT domain, model, sample_id FROM wide QUALIFY row_number() OVER (PARTITION BY domain ORDER BY model = 'sketch-large' DESC, model, sample_id) = 1")
def _(t: Tables):
    return ranking.first_preferred(wide(t).select("domain", "model", "sample_id"), ["domain"], F.col("model") == "sketch-large", "model", "sample_id")


@q("next_sample_id", r"""WITH m AS (SELECT max(try_cast(regexp_extract(sample_id, '^sample_(\d+)$', 1) AS BIGINT)) AS top FROM sample_meta), n AS (SELECT DISTINCT description_id FROM descriptions)
SELECT description_id, 'sample_' || lpad((top + row_number() OVER (ORDER BY description_id))::VARCHAR, greatest(4, length((top + row_number() OVER (ORDER BY description_id))::VARCHAR))::INTEGER, '0') AS sample_id FROM n, m""")
def _(t: Tables):
    """New ids from the greatest used number on."""
    top = t.sample_meta.agg(F.max(F.nullif(F.regexp_extract("sample_id", r"^sample_(\d+)$", 1), F.lit("")).cast("bigint"))).first()[0] or 0
    numbered = ranking.number_onwards(t.descriptions.select("description_id").distinct(), ["description_id"], int(top) + 1)
    return numbered.select("description_id", F.format_string("sample_%04d", "number").alias("sample_id"))


@q("first_k_models", "SELECT DISTINCT model_used AS model FROM diagrams ORDER BY model LIMIT 5")
def _(t: Tables):
    """W5."""
    return ranking.first_k(t.diagrams.select(F.col("model_used").alias("model")), "model", 5)


@q("leaderboard", f"WITH {WIDE}, s AS (SELECT model, avg(generation_time) AS m FROM wide GROUP BY model) SELECT model, round(m, 6) AS mean_time, row_number() OVER (ORDER BY m DESC NULLS LAST, model) AS place FROM s")
def _(t: Tables):
    """Over one row per model."""
    s = wide(t).groupBy("model").agg(F.avg("generation_time").alias("m"))
    return s.select("model", F.round("m", 6).alias("mean_time"), F.row_number().over(Window.orderBy(F.desc_nulls_last("m"), "model")).alias("place"))


@q("level_order_W7", f"SELECT level, n, CASE level WHEN 'easy' THEN 1 WHEN 'medium' THEN 2 WHEN 'hard' THEN 3 ELSE 0 END::BIGINT AS place FROM (SELECT {LEVEL} AS level, count(DISTINCT instruction_key) AS n FROM instructions GROUP BY 1)")
def _(t: Tables):
    n = t.instructions.groupBy(F.lower(F.get(F.split("instruction_id", "_"), F.lit(1))).alias("level")).agg(F.countDistinct("instruction_key").alias("n"))
    return n.withColumn("place", F.array_position(F.array(*[F.lit(x) for x in sc.LEVELS]), F.col("level"))).orderBy("place")


@q("head_W8", "SELECT DISTINCT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 20")
def _(t: Tables):
    return t.documents.select("doc_id", "n_chars").orderBy("doc_id").limit(20)


@q("first_domain_W9", f"SELECT min({DOMAIN}) AS domain, (SELECT array_to_string(min(atomic_operations)[1:2], '|') FROM instructions WHERE len(atomic_operations) > 0) AS first_two FROM sample_meta")
def _(t: Tables):
    two = t.instructions.where("size(atomic_operations) > 0").agg(F.array_join(F.slice(F.min("atomic_operations"), 1, 2), "|").alias("first_two"))
    return t.sample_meta.agg(F.min(folded(F.col("domain"))).alias("domain")).crossJoin(two)


@q("numbered_instructions_W10", "SELECT DISTINCT instruction_key, i::BIGINT AS position, 'inst_easy_' || lpad(i::VARCHAR, 3, '0') AS name, atomic_operations[i] AS operation FROM (SELECT instruction_key, atomic_operations, unnest(range(1, len(atomic_operations) + 1)) AS i FROM instructions)")
def _(t: Tables):
    rows = t.instructions.select("instruction_key", F.posexplode("atomic_operations").alias("p", "operation")).distinct()
    return rows.select("instruction_key", (F.col("p") + 1).alias("position"), F.format_string("inst_easy_%03d", F.col("p") + 1).alias("name"), "operation")


@q("content_hash_dedup", "SELECT doc_id, md5(text) AS hash FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id DESC) = 1")
def _(t: Tables):
    """U8: the last id of each content; an aggregation, since a window would sort the largest group in one task."""
    return t.documents.groupBy(F.md5("text").alias("hash")).agg(F.max("doc_id").alias("doc_id"))


@q("stratified_sample", f"""WITH x AS (SELECT DISTINCT diagram_id, {DOMAIN} AS domain FROM diagrams), z AS (SELECT domain, count(*) AS size FROM x GROUP BY 1), f AS (SELECT min(domain) AS first FROM z),
s AS (SELECT domain, size, domain = first AS whole, greatest(0, 200 - sum(CASE WHEN domain = first THEN size ELSE 0 END) OVER ()) AS rest, sum(CASE WHEN domain != first THEN size ELSE 0 END) OVER () AS others FROM z, f),
w AS (SELECT *, least(greatest(1, floor(size / others * rest)), size) AS want FROM s),
u AS (SELECT *, sum(want) OVER (PARTITION BY whole ORDER BY size DESC, domain ROWS UNBOUNDED PRECEDING) AS upto FROM w),
a AS (SELECT *, least(upto, rest) - least(upto - want, rest) AS alloc FROM u),
c AS (SELECT *, CASE WHEN alloc > 0 THEN size - alloc ELSE 0 END AS cap, rest - sum(CASE WHEN whole THEN 0 ELSE alloc END) OVER () AS free FROM a),
b AS (SELECT *, sum(cap) OVER (PARTITION BY whole ORDER BY size DESC, domain ROWS UNBOUNDED PRECEDING) AS cap_upto FROM c),
k AS (SELECT domain, CASE WHEN whole THEN size ELSE alloc + least(cap_upto, free) - least(cap_upto - cap, free) END AS take FROM b)
SELECT diagram_id, domain FROM (SELECT x.*, take, row_number() OVER (PARTITION BY domain ORDER BY md5('42' || diagram_id), diagram_id) AS n FROM x JOIN k USING (domain)) WHERE n <= take""")
def _(t: Tables):
    """U7."""
    rows = t.diagrams.select("diagram_id", folded(F.col("domain")).alias("domain")).distinct()
    return ranking.stratified_sample(rows, "domain", "diagram_id", 200).select("diagram_id", "domain")
