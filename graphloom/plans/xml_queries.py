"""Metrics on XML, texts, boxes and vectors (M*), scans and sinks (S*, K*), streaming, as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metrics as me
from ..functions import scoring as sc
from ..functions.text import folded
from ..operators import matching, stats
from ..sources import readers, writers
from ..staging import Stage
from ..streaming.ingest import merge_stream
from .registry import Catalogue, Tables
from .stat_queries import WIDE, wide
from .text_queries import DOMAIN, in_list

C = Catalogue()
q = C.query


@q("execution_success_M1_M14", "SELECT DISTINCT diagram_id, CASE WHEN xml_content IS NOT NULL AND is_valid THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, true AS task1_success, xml_content IS NOT NULL AS task2_success FROM diagrams")
def _(t: Tables):
    x, r = F.col("xml_content"), F.coalesce("is_valid", F.lit(False))
    (s1, ok1), (_, ok2) = me.execution_success(x, r), me.execution_success(x, r, False)
    return t.diagrams.select("diagram_id", s1.alias("score"), ok1.alias("task1_success"), ok2.alias("task2_success")).distinct()


@q("token_metrics_M2_M15", "SELECT DISTINCT diagram_id, CASE WHEN xml_content IS NULL THEN NULL ELSE greatest(1, length(xml_content) // 4) END::DOUBLE AS task1, CASE WHEN xml_content IS NULL THEN 0 ELSE greatest(1, length(xml_content) // 4) END::DOUBLE AS task2 FROM diagrams")
def _(t: Tables):
    x = F.col("xml_content")
    return t.diagrams.select("diagram_id", me.token_metric(x)[0].alias("task1"), me.token_metric(x, 0.0)[0].alias("task2")).distinct()


@q("change_token_count_M16")
def _(t: Tables):
    """Tokens of the canonical text of a change list. The metric fails with 0 if it is missing or no JSON; the evaluator skips a missing one as NULL."""
    rows = t.descriptions.select("description_id", "components").distinct().withColumn("n", sc.change_tokens("components"))
    score = F.coalesce("n", F.lit(0)).cast("double")
    return rows.select("description_id", score.alias("score"), F.when(F.col("components").isNotNull(), score).alias("evaluator_score"), F.col("n").isNotNull().alias("success"))


@q("style_score_M3_M17", "SELECT event_id, greatest(0.0, least(1.0, CASE WHEN event_id % 3 = 0 THEN round(value / 100, 4) WHEN event_id % 3 = 1 THEN (5 + 7) / 20.0 ELSE round(value / 100, 4) END))::DOUBLE AS score FROM events")
def _(t: Tables):
    """A reply with a final score, one with dimensions only, one that is a bare number in words."""
    v = F.round(F.col("value") / 100, 4).cast("string")
    plain = F.format_string("%.4f", F.round(F.col("value") / 100, 4))
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"final_score": '), v, F.lit("}"))).when(F.col("event_id") % 3 == 1, F.lit('{"final_score": 0, "layout": 5, "colour": 7}')).otherwise(F.concat(F.lit("about "), plain))
    return t.events.select("event_id", me.style_score(reply, ["layout", "colour"]).alias("score"))


BOX = "b AS (SELECT l_orderkey, l_linenumber, l_quantity AS w, l_suppkey % 50 AS h, l_partkey % 100 AS x, l_suppkey % 90 AS y FROM lineitem)"


def _boxes(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("w"), (F.col("l_suppkey") % 50).alias("h"), (F.col("l_partkey") % 100).alias("x"), (F.col("l_suppkey") % 90).alias("y"))


@q("box_type", f"WITH {BOX}, r AS (SELECT *, CASE WHEN h > 0 THEN w / h ELSE 1.0 END AS ratio FROM b) SELECT CASE WHEN ratio > 5 OR ratio < 0.2 THEN 'edge' WHEN w > 20 AND h > 20 THEN 'node' WHEN w < 50 AND h < 50 THEN 'text' ELSE 'unknown' END AS kind, count(*) AS n FROM r GROUP BY 1")
def _(t: Tables):
    """M5."""
    return _boxes(t).groupBy(me.box_type(F.col("w"), F.col("h")).alias("kind")).agg(F.count("*").alias("n"))


@q("iou_pairs", f"""WITH {BOX}, p AS (SELECT *, lead(x) OVER o AS x2, lead(y) OVER o AS y2, lead(w) OVER o AS w2, lead(h) OVER o AS h2 FROM b WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, x, y, w, h)),
i AS (SELECT *, greatest(0, least(x + w, x2 + w2) - greatest(x, x2)) * greatest(0, least(y + h, y2 + h2) - greatest(y, y2)) AS common FROM p WHERE x2 IS NOT NULL)
SELECT l_orderkey, round(avg(CASE WHEN w * h + w2 * h2 - common > 0 THEN common / (w * h + w2 * h2 - common) ELSE 0 END), 6) AS mean_iou FROM i GROUP BY l_orderkey""")
def _(t: Tables):
    """M6: neighbouring boxes of an order."""
    o = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "x", "y", "w", "h")
    p = _boxes(t).select("*", *[F.lead(c).over(o).alias(f"{c}2") for c in "xywh"]).where("x2 IS NOT NULL")
    one, two = ({c: F.col(c + s) for c in "xywh"} for s in ("", "2"))
    return p.groupBy("l_orderkey").agg(F.round(F.avg(me.iou(one, two)), 6).alias("mean_iou"))


@q("optimal_match")
def _(t: Tables):
    """Boxes of an order against the boxes of the next order, by centres."""
    b = _boxes(t).groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in "xywh"]).withColumn("kind", me.box_type(F.col("w"), F.col("h")))
    a = b.select(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").cast("bigint").alias("left_id"), F.col("kind").alias("k1"), *[F.col(c).alias(f"{c}1") for c in "xywh"])
    r = b.select((F.col("l_orderkey") - 1).alias("grp"), F.col("l_linenumber").cast("bigint").alias("right_id"), F.col("kind").alias("k2"), *[F.col(c).alias(f"{c}2") for c in "xywh"])
    cost = me.matching_cost(F.col("k1"), F.col("k2"), {c: F.col(f"{c}1") for c in "xywh"}, {c: F.col(f"{c}2") for c in "xywh"})
    return matching.optimal_pairs(a.join(r, "grp").select("grp", "left_id", "right_id", cost.alias("cost")), "grp")


@q("structural_fidelity_M4_A28")
def _(t: Tables):
    """Mean IoU of the boxes of an order and those of the next order, matched by centres."""
    b = _boxes(t).groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).cast("double").alias(c) for c in "xywh"])
    b = b.select(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").cast("bigint").alias("id"), me.box_type(F.col("w"), F.col("h")).alias("kind"), *"xywh")
    return matching.structural_fidelity(b, b.withColumn("grp", F.col("grp") - 1), "grp").withColumn("score", F.round("score", 9))


@q("element_recall_rate_M8")
def _(t: Tables):
    """M8: element lines of a description, its summary and annotations, that the recorded description of the rendering, here the summary, has too."""
    d = t.descriptions.select("description_id", "summary", F.when(F.col("summary").isNotNull(), F.concat_ws("\n", "summary", "annotations")).alias("original")).distinct()
    return matching.element_recall(d, "description_id", "original", "summary")


@q("jaccard_words", r"""WITH p AS (SELECT DISTINCT pair_id, question, visual_anchor FROM qa_pairs), w AS (SELECT pair_id, list_distinct(list_filter(string_split_regex(lower(question), '\s+'), lambda x: x != '')) AS a, list_distinct(list_filter(string_split_regex(lower(visual_anchor), '\s+'), lambda x: x != '')) AS b FROM p)
SELECT pair_id, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(a || b)) ELSE 0 END, 9) AS similarity FROM w""")
def _(t: Tables):
    """M9."""
    p = t.qa_pairs.select("pair_id", "question", "visual_anchor").distinct()
    return p.select("pair_id", F.round(sc.word_jaccard(F.col("question"), F.col("visual_anchor")), 9).alias("similarity"))


@q("batch_replies_M12", "SELECT event_id, 'a' || event_id AS first, 'b' || event_id AS second FROM events")
def _(t: Tables):
    """Batch replies as an array, as an object and as lines."""
    a, b = F.concat(F.lit("a"), "event_id"), F.concat(F.lit("b"), "event_id")
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["'), a, F.lit('", "'), b, F.lit('"]'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"Q1": "'), a, F.lit('", "Q2": "'), b, F.lit('"}'))).otherwise(F.concat(F.lit("Q1: "), a, F.lit("\nQ2: "), b))
    answers = me.numbered_answers(reply, 2)
    return t.events.select("event_id", F.get(answers, F.lit(0)).alias("first"), F.get(answers, F.lit(1)).alias("second"))


@q("cosine_similarity", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t: Tables):
    """Each vector and the next."""
    a, b = t.embeddings.select("vec_id", F.col("embedding").alias("e1")), t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    return a.join(b, "vec_id").select("vec_id", F.round(me.cosine(F.col("e1"), F.col("e2")), 6).alias("cosine"))


@q("xdrfr_M18", "SELECT user_id, count(*) AS questions, count(*) FILTER (event_type IN ('click', 'view')) AS satisfied, round(count(*) FILTER (event_type IN ('click', 'view')) / count(*), 6) AS score FROM events GROUP BY user_id")
def _(t: Tables):
    """Satisfied questions over all."""
    answer = F.when(F.col("event_type").isin("click", "view"), " YES ").otherwise("maybe")
    yes = F.count_if(sc.yes_no(answer) == "Yes")
    return t.events.groupBy("user_id").agg(F.count("*").alias("questions"), yes.alias("satisfied"), F.round(yes / F.count("*"), 6).alias("score"))


def _votes(marks: tuple[str, ...]) -> str:
    return in_list(marks, "lower(answer)")


@q("yes_no_text_M20", f"SELECT DISTINCT pair_id, CASE WHEN {_votes(sc.YES_MARKS)} > {_votes(sc.NO_MARKS)} THEN 'Yes' WHEN {_votes(sc.NO_MARKS)} > {_votes(sc.YES_MARKS)} THEN 'No' WHEN length(trim(answer)) <= 5 AND (contains(lower(answer), 'y') OR contains(answer, '是')) THEN 'Yes' ELSE 'No' END AS reply FROM qa_pairs WHERE answer IS NOT NULL")
def _(t: Tables):
    return t.qa_pairs.where("answer IS NOT NULL").select("pair_id", sc.yes_no_of_text(F.col("answer")).alias("reply")).distinct()


@q("char_edit_distance", "SELECT a.p_partkey, levenshtein(a.p_name, b.p_name)::BIGINT AS distance, round(levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)), 9) AS share FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def _(t: Tables):
    """M25, M21."""
    a, b = t.part.select("p_partkey", F.col("p_name").alias("n1")), t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("n2"))
    return a.join(b, "p_partkey").select("p_partkey", F.levenshtein("n1", "n2").alias("distance"), F.round(me.edit_distance(F.col("n1"), F.col("n2"), "character"), 9).alias("share"))


@q("token_edit_distance", r"""WITH i AS (SELECT DISTINCT instruction_key, list_transform(atomic_operations, lambda x: split_part(x, ' ', 1)) AS a, list_reverse(list_transform(atomic_operations, lambda x: split_part(x, ' ', 1))) AS b FROM instructions WHERE atomic_operations IS NOT NULL),
v AS (SELECT *, list_distinct(a || b) AS u FROM i)
SELECT instruction_key, levenshtein(array_to_string(list_transform(a, lambda x: chr((64 + list_position(u, x))::INTEGER)), ''), array_to_string(list_transform(b, lambda x: chr((64 + list_position(u, x))::INTEGER)), ''))::BIGINT AS distance FROM v""")
def _(t: Tables):
    """Operation words of an instruction against the same in reverse."""
    i = t.instructions.where("atomic_operations IS NOT NULL").select("instruction_key", F.transform("atomic_operations", lambda x: F.get(F.split(x, " "), F.lit(0))).alias("a")).distinct()
    return i.select("instruction_key", me.sequence_distance(F.col("a"), F.reverse("a")).alias("distance"))


@q("xml_tokens_M24", r"""SELECT DISTINCT diagram_id, len(regexp_extract_all(xml_content, '<[^>]+>'))::BIGINT AS tags, len(list_filter(string_split_regex(regexp_replace(xml_content, '<[^>]+>', ' ', 'g'), '\s+'), lambda w: w != ''))::BIGINT AS words FROM diagrams""")
def _(t: Tables):
    tokens = me.xml_tokens(F.col("xml_content"))
    tags = F.filter(tokens, lambda x: x.startswith("<") & x.endswith(">") & (F.length(x) > 2))
    return t.diagrams.select("diagram_id", F.regexp_count("xml_content", F.lit("<[^>]+>")).alias("tags"), (F.size(tokens) - F.regexp_count("xml_content", F.lit("<[^>]+>"))).alias("words")).distinct()


@q("xml_tree_distance")
def _(t: Tables):
    """Each readable diagram against itself with one attribute changed; texts that are not well-formed by tokens."""
    d = t.diagrams.where("xml_content IS NOT NULL").select("diagram_id", "xml_content").distinct()
    d = d.withColumn("changed", F.regexp_replace("xml_content", 'vertex="1"', 'vertex="0"'))
    return me.with_tree_distance(d, "xml_content", "changed", "distance").select("diagram_id", F.round("distance", 9).alias("distance"))


@q("edit_precision", """WITH i AS (SELECT DISTINCT instruction_key, instruction, list_distinct(list_transform(atomic_operations, lambda x: split_part(x, ' ', 1))) AS a FROM instructions WHERE atomic_operations IS NOT NULL), s AS (SELECT *, list_filter(a, lambda x: x < 'm') AS b FROM i),
n AS (SELECT *, list_filter(a, lambda x: contains(lower(instruction), lower(x))) AS named, list_filter(a, lambda x: NOT list_contains(b, x)) AS changed FROM s)
SELECT instruction_key, round(0.7 * CASE WHEN len(named) > 0 THEN len(list_intersect(named, changed)) / len(named) ELSE 1 END + 0.3 * CASE WHEN len(a) > 0 THEN 1 - len(list_filter(changed, lambda x: NOT list_contains(named, x))) / len(a) ELSE 1 END, 9) AS score FROM n WHERE instruction IS NOT NULL""")
def _(t: Tables):
    """Operation words stand for ids; those before m stay."""
    i = t.instructions.where("atomic_operations IS NOT NULL AND instruction IS NOT NULL").select("instruction_key", "instruction", F.array_distinct(F.transform("atomic_operations", lambda x: F.get(F.split(x, " "), F.lit(0)))).alias("a")).distinct()
    return i.select("instruction_key", F.round(me.edit_precision(F.col("instruction"), F.col("a"), F.filter("a", lambda x: x < "m")), 9).alias("score"))


@q("subjective_completion_M27", f"SELECT DISTINCT instruction_key, CASE WHEN {in_list(sc.SUBJECTIVE_WORDS, 'lower(instruction)')} = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS score FROM instructions WHERE instruction IS NOT NULL")
def _(t: Tables):
    """No subjective word is complete; else the judge's score, here a recorded one."""
    recorded = sc.clamp(F.try_variant_get(sc.json_of(F.lit('Judge: {"score": 0.5}')), "$.score", "double"))
    return t.instructions.where("instruction IS NOT NULL").select("instruction_key", F.when(~sc.any_word(F.col("instruction"), sc.SUBJECTIVE_WORDS), 1.0).otherwise(recorded).alias("score")).distinct()


BUILT = "'<mxGraphModel><root>' || string_agg('<mxCell id=\"' || l_linenumber || '\" ' || CASE WHEN l_returnflag = 'A' THEN 'edge' ELSE 'vertex' END || '=\"1\"/>', '' ORDER BY l_linenumber, l_partkey) || '</root></mxGraphModel>'"


@q("xml_counts", "SELECT l_orderkey, (count(*) + 2)::BIGINT AS elements, count(*) FILTER (l_returnflag != 'A') AS nodes, count(*) FILTER (l_returnflag = 'A') AS edges FROM lineitem GROUP BY l_orderkey")
def _(t: Tables):
    """Counts of XML built from the lines of an order; the oracle counts the lines."""
    kind = F.when(F.col("l_returnflag") == "A", "edge").otherwise("vertex")
    cells = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.concat(F.lit('<mxCell id="'), "l_linenumber", F.lit('" '), kind, F.lit('="1"/>'))), "").alias("cells"))
    facts = cells.select("l_orderkey", me.xml_facts(F.concat(F.lit("<mxGraphModel><root>"), "cells", F.lit("</root></mxGraphModel>"))).alias("f"))
    return facts.select("l_orderkey", "f.elements", "f.nodes", "f.edges")


@q("xml_valid")
def _(t: Tables):
    """Validity, errors and counts of the diagrams as they are."""
    d = t.diagrams.select("diagram_id", "xml_content").distinct().select("diagram_id", me.xml_facts("xml_content").alias("f"))
    return d.select("diagram_id", "f.valid", "f.elements", "f.nodes", "f.edges", F.array_join("f.errors", "; ").alias("errors"))


@q("patch_apply", "SELECT p_partkey, 'NEW' || p_name[length(split_part(p_name, ' ', 1)) + 1:] AS name FROM part")
def _(t: Tables):
    """The exact step; of a fragment that recurs the first place counts."""
    first = F.get(F.split("p_name", " "), F.lit(0))
    change = F.array(F.struct(first.alias("original_fragment"), F.lit("NEW").alias("modified_fragment")), F.struct(F.lit("not there").alias("original_fragment"), F.lit("x").alias("modified_fragment")))
    return t.part.select("p_partkey", me.patch_exact(F.col("p_name"), change).alias("name"))


@q("patch_apply_spaced_M30", "SELECT p_partkey, 'NEW' AS name FROM part")
def _(t: Tables):
    """A fragment that differs from the text in white space only."""
    change = F.array(F.struct(F.replace("p_name", F.lit(" "), F.lit("\n  ")).alias("original_fragment"), F.lit("NEW").alias("modified_fragment")))
    return t.part.select("p_partkey", me.patch(F.col("p_name"), change).alias("name"))


@q("single_evaluation_M32", "SELECT diagram_id, 1.0::DOUBLE AS execution_success_rate, greatest(1, length(xml_content) // 4)::DOUBLE AS xml_token_count FROM (SELECT DISTINCT diagram_id, xml_content FROM diagrams WHERE is_valid AND xml_content IS NOT NULL) ORDER BY diagram_id LIMIT 1")
def _(t: Tables):
    """One diagram, evaluated by the registry (M1, M2); the evaluation document is written and read back."""
    base = _stage(t, "evaluation")
    one = t.diagrams.where("is_valid AND xml_content IS NOT NULL").orderBy("diagram_id").limit(1)
    rows = me.default_registry().evaluate(one.select("diagram_id", F.col("xml_content").alias("xml"), F.lit(True).alias("rendered")), ["diagram_id"])
    document = rows.groupBy("diagram_id").agg(*[F.max(F.when(F.col("metric") == m, F.col("score"))).alias(m) for m in ("execution_success_rate", "xml_token_count")])
    writers.write_documents(document, base)
    return t.spark.read.schema("diagram_id bigint, execution_success_rate double, xml_token_count double").json(base)


# --- scans and sinks: written, read again, compared with the table ---------------


def _stage(t: Tables, name: str) -> str:
    return Stage(t.spark, name).base


META = f"SELECT DISTINCT {DOMAIN} AS domain, sample_id, element_count::BIGINT AS element_count, xml_token_count::BIGINT AS xml_token_count FROM sample_meta"


def _meta(t: Tables):
    return t.sample_meta.select(folded(F.col("domain")).alias("domain"), "sample_id", "element_count", "xml_token_count").distinct()


@q("tree_scan_S8_S10_K6", f"WITH m AS ({META}) SELECT * FROM m WHERE domain IN ('domain_software_domain_uml', 'domain_general_domain_mindmap')")
def _(t: Tables):
    """JSON documents in folders by domain; the filter prunes folders."""
    base = _stage(t, "tree")
    writers.write_fragments(_meta(t), base, ["domain"])
    return readers.read_fragments(t.spark, base, "sample_id string, element_count int, xml_token_count int, domain string").where(F.col("domain").isin("domain_software_domain_uml", "domain_general_domain_mindmap"))


_FRAGMENTS = f"d AS (SELECT DISTINCT {DOMAIN} AS domain, split_part(model_used, '/', -1) AS model, diagram_id FROM diagrams)"


@q("fragment_modes_S9_S10", f"""WITH {_FRAGMENTS} SELECT 'both' AS mode, * FROM d WHERE model = 'sketch-large' AND domain = 'domain_software_domain_uml' UNION ALL SELECT 'model', * FROM d WHERE model = 'sketch-large'
UNION ALL SELECT 'domain', * FROM d WHERE domain = 'domain_software_domain_uml' UNION ALL SELECT 'all', * FROM d""")
def _(t: Tables):
    """Fragments by model and domain, read in the four modes."""
    base = _stage(t, "fragments")
    writers.write_fragments(wide(t).select("domain", "model", "diagram_id").distinct(), base, ["model", "domain"])
    modes = {"both": ("sketch-large", "domain_software_domain_uml"), "model": ("sketch-large", None), "domain": (None, "domain_software_domain_uml"), "all": (None, None)}
    parts = [readers.existing_fragments(t.spark, base, "diagram_id bigint, model string, domain string", *m).select(F.lit(name).alias("mode"), "domain", "model", "diagram_id") for name, m in modes.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@q("two_shapes_S12", "SELECT event_id, value FROM events")
def _(t: Tables):
    """The same list inside an object and bare."""
    row = F.to_json(F.struct("event_id", "value"))
    group = F.floor(F.col("event_id") / 1000)  # documents of a thousand ids
    listed = t.events.groupBy(group.alias("g")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(row), ","), F.lit("]")).alias("doc"))
    docs = listed.select(F.when(F.col("g") % 2 == 0, F.concat(F.lit('{"samples":'), "doc", F.lit("}"))).otherwise(F.col("doc")).alias("doc"))
    return readers.rows_of_documents(docs, "doc", "array<struct<event_id:bigint,value:double>>", ["samples", "instructions"])


@q("csv_round_trip_S13_K7", f"{META}")
def _(t: Tables):
    base = _stage(t, "csv")
    writers.write_csv(_meta(t), base)
    return t.spark.read.csv(base, header=True, schema="domain string, sample_id string, element_count int, xml_token_count int")


@q("performance_scan_S11", "SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN try_cast(json_extract_string(props, '$.k') AS BIGINT) END, 0) AS tokens FROM events")
def _(t: Tables):
    """Nested token counts, 0 where the part is missing."""
    doc = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"token_usage": {"xml": {"completion_tokens": '), F.get_json_object("props", "$.k"), F.lit("}}}"))).otherwise(F.lit("{}"))
    usage = F.from_json(doc, "token_usage struct<xml:struct<completion_tokens:bigint>>")
    return t.events.select("event_id", F.coalesce(usage["token_usage"]["xml"]["completion_tokens"], F.lit(0)).alias("tokens"))


@q("model_discovery_S20", f"WITH {WIDE} SELECT DISTINCT model FROM wide WHERE model IS NOT NULL")
def _(t: Tables):
    """The models whose folders exist, by name."""
    base = _stage(t, "models")
    writers.write_fragments(wide(t).select("domain", "model", "diagram_id"), base, ["model", "domain"])
    return readers.read_fragments(t.spark, base, "diagram_id bigint, model string, domain string").select("model").where("model IS NOT NULL").distinct().orderBy("model")


@q("figures_S16", "SELECT DISTINCT description_id, i::BIGINT AS place, a AS caption FROM (SELECT description_id, unnest(annotations) AS a, unnest(range(1, len(annotations) + 1)) AS i FROM descriptions)")
def _(t: Tables):
    """Content items of a document as rows."""
    content = F.transform("annotations", lambda a: F.struct(F.lit("image").alias("type"), a.alias("caption")))
    rows = t.descriptions.select("description_id", content.alias("content"))
    return readers.content_items(rows, "description_id", "content", "image").select("description_id", "place", "caption").distinct()


@q("nested_export", "SELECT o_custkey AS custkey, count(*) AS orders, sum(lines)::BIGINT AS lines FROM (SELECT o_custkey, o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines FROM orders) GROUP BY 1")
def _(t: Tables):
    """Customer, orders and lines as one nested document each; sizes read from the document."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("lines"))
    orders = t.orders.join(lines, "o_orderkey", "left")
    doc = writers.nested(orders, ["o_custkey"], ["o_orderkey", "lines"], "orders")
    parsed = F.from_json(F.to_json(F.struct("orders")), "orders array<struct<o_orderkey:bigint,lines:array<struct<l_linenumber:int>>>>")["orders"]
    total = F.aggregate(F.transform(parsed, lambda o: F.greatest(F.size(F.coalesce(o["lines"], F.array().cast("array<struct<l_linenumber:int>>"))), F.lit(0))), F.lit(0), lambda a, b: a + b)
    return doc.select(F.col("o_custkey").alias("custkey"), F.size(parsed).alias("orders"), total.alias("lines"))


@q("routed_gallery_K3_K4", "SELECT doc_id, n_chars >= 600 AS is_candidate, n_chars >= 600 AS approved FROM documents")
def _(t: Tables):
    """Rows routed to folders by candidacy and a review file in which approval follows candidacy."""
    base = _stage(t, "gallery")
    rows = writers.review(t.documents.select("doc_id", (F.col("n_chars") >= 600).alias("is_candidate")))
    rows.write.partitionBy("is_candidate").json(base)
    return t.spark.read.schema("doc_id bigint, approved boolean, is_candidate boolean").json(base)


@q("status_index_K11_K12_K13", f"WITH {WIDE} SELECT domain, count(*) AS samples, count(*) FILTER (is_valid) AS approved, round(count(*) FILTER (is_valid) / count(*), 6) AS progress FROM wide GROUP BY domain")
def _(t: Tables):
    """Index documents (K11), copies of the approved samples (K12) and a progress document per domain (K13), written and read back.

    An index document has the samples of a domain whose ids fall into the same thousand, so no document grows with its domain.
    """
    base = _stage(t, "index")
    w = wide(t)
    index = writers.nested(w.withColumn("part", F.floor(F.col("diagram_id") / 1000)), ["domain", "part"], ["sample_id", "model", "is_valid"], "samples")
    progress = w.groupBy("domain").agg(F.round(F.count_if("is_valid") / F.count("*"), 6).alias("progress"))
    writers.write_parts({"index": index, "approved": w.where("is_valid").select("domain", "sample_id", "diagram_id"), "progress": progress}, base)
    read = readers.read_parts(t.spark, base, {"index": "domain string, samples array<struct<sample_id:string,is_valid:boolean>>", "approved": "domain string, diagram_id bigint", "progress": "domain string, progress double"})
    counts = read["index"].groupBy("domain").agg(F.sum(F.size("samples")).alias("samples"))
    copies = read["approved"].groupBy("domain").agg(F.count("*").alias("approved"))
    return counts.join(copies, "domain", "left").fillna(0, ["approved"]).join(read["progress"], "domain")


@q("delete_by_predicate_K15", f"WITH m AS ({META}) SELECT * FROM m WHERE domain IN (SELECT domain FROM m GROUP BY domain HAVING count(*) >= 30)")
def _(t: Tables):
    """Folders of small shards are deleted; what stays is read back."""
    base = _stage(t, "shards")
    _meta(t).write.partitionBy("domain").parquet(base)
    schema = "sample_id string, element_count int, xml_token_count int, domain string"
    rows = t.spark.read.schema(schema).parquet(base)
    small = rows.groupBy("domain").count().where("count < 30").select("domain")
    writers.delete_folders(t.spark, rows.select("domain", "_metadata").join(small, "domain", "left_semi"))
    return t.spark.read.schema(schema).parquet(base)


@q("chart_data_K14", f"WITH {WIDE} SELECT domain, model, count(*) AS n, round(avg(generation_time), 9) AS mean_time FROM wide GROUP BY ALL")
def _(t: Tables):
    """What a heat map shows."""
    return wide(t).groupBy("domain", "model").agg(F.count("*").alias("n"), F.round(F.avg("generation_time"), 9).alias("mean_time"))


@q("chart_points_K14", f"""WITH {WIDE}, m AS (SELECT model, count(*) AS n, avg(xml_token_count) AS x, avg(execution_success_rate) AS y FROM wide GROUP BY model)
SELECT 'bar' AS chart, model AS name, NULL::DOUBLE AS x, n::DOUBLE AS y FROM m UNION ALL SELECT 'pie', model, NULL, round(n / sum(n) OVER (), 9) FROM m UNION ALL SELECT 'scatter', model, round(x, 6), round(y, 6) FROM m""")
def _(t: Tables):
    """What a bar chart, a pie and a scatter plot of the models show; histogram and box are A15."""
    m = wide(t).groupBy("model").agg(F.count("*").alias("n"), F.avg("xml_token_count").alias("x"), F.avg("execution_success_rate").alias("y"))
    total = m.agg(F.sum("n").alias("all"))  # one row
    m = m.crossJoin(F.broadcast(total))
    none = F.lit(None).cast("double")
    points = F.array(F.struct(F.lit("bar").alias("chart"), none.alias("x"), F.col("n").cast("double").alias("y")), F.struct(F.lit("pie").alias("chart"), none.alias("x"), F.round(F.col("n") / F.col("all"), 9).alias("y")), F.struct(F.lit("scatter").alias("chart"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y")))
    return m.select(F.col("model").alias("name"), F.inline(points)).select("chart", "name", "x", "y")


@q("axis_bounds_P44", f"""WITH {WIDE}, m AS (SELECT model, avg(xml_token_count) AS x, avg(execution_success_rate) AS y FROM wide GROUP BY model), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM m),
e AS (SELECT *, CASE WHEN x1 > x0 THEN (x1 - x0) * 0.3 ELSE 0.05 END AS mx, CASE WHEN y1 > y0 THEN (y1 - y0) * 0.3 ELSE 0.02 END AS my FROM b)
SELECT round(x0 - mx, 6) AS zone_x, round(y0 - my, 6) AS zone_y, round(CASE WHEN x1 > x0 THEN x1 - x0 + 2 * mx ELSE 0.15 END, 6) AS zone_width, round(CASE WHEN y1 > y0 THEN y1 - y0 + 2 * my ELSE 0.05 END, 6) AS zone_height, round(y0 - (y1 - y0) * 0.5, 6) AS y_lower, round(y1 + (y1 - y0) * 0.2, 6) AS y_upper FROM e""")
def _(t: Tables):
    """The highlighted zone around the models and the limits of the axis."""
    m = wide(t).groupBy("model").agg(F.avg("xml_token_count").alias("x"), F.avg("execution_success_rate").alias("y"))
    return stats.axis_bounds(m, "x", "y")


@q("stream_merge", "SELECT event_type, user_id, arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def _(t: Tables):
    """Fragments read as a stream and merged by the last write."""
    return merge_stream(t.spark, t.sf_dir, "events.parquet", t.events.schema, ["event_type", "user_id"], ["ts", "event_id"], ["value", "event_id"])
