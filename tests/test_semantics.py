"""Literal cases of the rules and traps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import metrics as me
from graphloom.functions import paths as pa
from graphloom.functions import scoring as sc
from graphloom.operators import matching, quality, ranking, stats, store


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("answer", "truth", "kind", "right"), [
    ("there are 3", "3", "counting", True), ("03", "3", "counting", False), ("3.5", "35", "counting", True),
    ("B, A", "A and B", "relationship", True), ("A and B and C", "A and B", "relationship", True),
    ("!!!", "Work Arrangement", "identification", False), ("!!!", "Blue", "identification", True), ("设计部", "设计部门", "identification", True),
    ("Yes", "yes", "other", True), (None, "a", "counting", False), ("x", None, "identification", False),
])
def test_answers(answer, truth, kind, right):
    assert me.answer_is_correct(answer, truth, kind) is right


def test_tokens_words_levels(spark):
    assert [one(spark, sc.token_estimate(F.lit(t))) for t in ("", "1234567", "12345678", "图" * 8)] == [1, 1, 2, 2]
    assert [one(spark, sc.word_count(F.lit(t))) for t in ("", "  ", " a  b\n")] == [0, 0, 2]
    assert [one(spark, sc.level_from_id(F.lit(i))) for i in ("inst_easy_001", "inst_foo_1", "x_easy_1")] == ["Easy", "Foo", None]
    assert [one(spark, sc.strict_level_from_id(F.lit(i))) for i in ("inst_easy_001", "inst_foo_1")] == ["Easy", None]


def test_yes_no_and_retry(spark):
    assert [one(spark, sc.yes_no(F.lit(a))) for a in ("是", " TRUE ", "1", "maybe")] == ["Yes", "Yes", "Yes", "No"]
    assert [one(spark, sc.yes_no_of_text(F.lit(a))) for a in ("It satisfies all", "does not meet", "y", "?")] == ["Yes", "No", "Yes", "No"]
    assert one(spark, sc.retryable(F.lit("ReadTimeout"), F.lit("x"))) is True
    assert one(spark, sc.retryable(F.lit("AttributeError"), F.lit("'str' object has no attribute 'choices'"))) is True
    assert one(spark, sc.retryable(F.lit("KeyError"), F.lit("no key"))) is False
    assert one(spark, sc.retryable(F.lit(None).cast("string"), F.lit(None).cast("string"))) is False


def test_box_types_and_iou(spark):
    assert [one(spark, me.box_type(F.lit(w), F.lit(h))) for w, h in ((100, 10), (30, 30), (10, 10), (60, 19), (5, 0))] == ["edge", "node", "text", "unknown", "text"]
    box = lambda x, y, w, h: {"x": F.lit(x), "y": F.lit(y), "w": F.lit(w), "h": F.lit(h)}
    assert one(spark, me.iou(box(0, 0, 2, 2), box(1, 0, 2, 2))) == pytest.approx(1 / 3)
    assert one(spark, me.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0


def test_assignment_is_optimal_and_refuses_infinite_costs():
    cost = np.array([[4.0, 1.0, 3.0], [2.0, 0.0, 5.0]])
    assert me.assignment(cost) == [(0, 1), (1, 0)]
    with pytest.raises(ValueError):
        me.assignment(np.full((2, 2), np.inf))


def test_greedy_is_first_fit():
    assert me.greedy_matches(["a b", "a b c"], ["a b c", "a b"]) == [(0, 0), (1, 1)]


def test_edit_distances(spark):
    seq = lambda *x: F.array(*[F.lit(v) for v in x])
    assert one(spark, me.sequence_distance(seq("ab", "c", "图"), seq("ab", "图"))) == 1
    df = spark.createDataFrame([(1, "<a x='1'><b/></a>", "<a x='2'><b/></a>"), (2, "<a><b></a>", "<a><b></a>"), (3, "<a><b></a>", "<a></a>"), (4, None, "<a/>")], "i int, p string, q string")
    got = {r.i: r.d for r in me.with_tree_distance(df, "p", "q", "d").select("i", "d").collect()}
    assert got[1] == pytest.approx(1 / 3) and got[2] == 0 and got[3] == pytest.approx(1 / 3)


def test_patch(spark):
    change = "array(named_struct('original_fragment', {!r}, 'modified_fragment', {!r}))"
    assert one(spark, me.patch_exact(F.lit("aXbX"), F.expr(change.format("X", "_")))) == "a_bX"
    assert one(spark, me.patch(F.lit("<a  x='1'>"), F.expr('array(named_struct("original_fragment", "<a x=\'1\'>", "modified_fragment", "<b>"))'))) == "<b>"
    assert one(spark, me.patch(F.lit("abc"), F.expr(change.format("zz", "_")))) == "abc"


def test_xml_facts(spark):
    df = spark.createDataFrame([("<a><b></a>",), ("<mxGraphModel><root><mxCell vertex='1'/></root></mxGraphModel>",), (None,)], "x string")
    rows = [r[0] for r in df.select(me.xml_facts("x")).collect()]
    assert [(r.valid, r.elements, r.nodes) for r in rows] == [(False, 0, 0), (True, 3, 1), (False, 0, 0)]


def test_style_scores(spark):
    dims = ["a", "b"]
    cases = {'{"final_score": 0.7}': 0.7, '{"final_score": 0, "a": 6, "b": 8}': 0.7, "score 0.4": 0.4, '{"final_score": 7}': 1.0, "nothing": 0.0}
    assert {k: pytest.approx(one(spark, me.style_score(F.lit(k), dims))) for k in cases} == cases
    assert one(spark, me.style_score(F.lit("8 of 10"), dims, per_ten=True)) == pytest.approx(0.8)


def test_replies(spark):
    assert one(spark, sc.extract_xml(F.lit("x ```xml\n<a/>\n``` y"))) == "<a/>"
    assert one(spark, sc.extract_xml(F.lit("t <mxGraphModel>1</mxGraphModel> u"))) == "<mxGraphModel>1</mxGraphModel>"
    assert one(spark, sc.extract_xml(F.lit("```xml\n<a/>"))) == "<a/>"
    assert one(spark, sc.extract_xml(F.lit("```xml\n<a/>"), strict_compat=True)) == "<a/"
    assert one(spark, F.size(sc.changes_of(F.lit('[{"original_fragment": "a", "modified_fragment": "b"}, {"original_fragment": "a"}]')))) == 1


def test_paths(spark):
    p = F.lit("/x/domain_a/sample_1/domain_b/y.png")
    assert one(spark, pa.first_segment(p, "domain_")) == "domain_a" and one(spark, pa.last_segment(p, "domain_")) == "domain_b"
    assert one(spark, pa.relative(F.lit("C:\\b\\benchmark\\a.png"), "benchmark")) == "benchmark/a.png"
    assert one(spark, pa.safe_file_name(F.lit('a<b>: c?.png'))) == "a_b_c_.png"
    assert len(one(spark, pa.safe_file_name(F.lit("x" * 300 + ".png")))) == 199
    assert [one(spark, pa.human_size(F.lit(n))) for n in (10, 2048, 3 * 1024**5)] == ["10.0 B", "2.0 KB", "3.0 PB"]


def test_corruption_and_zeros(spark):
    m = F.create_map(F.lit("m"), F.lit(1.0))
    bad = quality.clear_if_corrupted(m, F.lit("domain_a"), F.lit("sample_1"), F.lit(None).cast("string"), F.lit("x/domain_b/sample_1/i.png"))
    good = quality.clear_if_corrupted(m, F.lit("domain_a"), F.lit("sample_1"), F.lit("x/domain_a/sample_1/i.png"))
    assert one(spark, F.size(bad)) == 0 and one(spark, F.size(good)) == 1
    assert one(spark, quality.corrupted(F.lit("domain_a"), F.lit(None).cast("string"))) is False
    assert one(spark, quality.failed_zero_to_null(F.lit(0.0), F.lit(False))) is None and one(spark, quality.failed_zero_to_null(F.lit(0.0), F.lit(True))) == 0.0


def test_store(spark):
    rows = spark.createDataFrame([("k", "a", 1, 1.0), ("k", "a", 2, None), ("k", "b", 1, 2.0)], "key string, metric string, seq int, score double")
    assert {tuple(r) for r in store.latest(rows, ["key", "metric"], ["seq"], ["score"]).collect()} == {("k", "a", None), ("k", "b", 2.0)}
    old = spark.createDataFrame([("k", {"a": 1.0, "b": 1.0}), ("o", {"a": 5.0})], "key string, m map<string,double>")
    new = spark.createDataFrame([("k", {"b": 2.0}), ("n", {"z": 9.0})], "key string, m map<string,double>")
    once = store.merge_metric_maps(old, new, ["key"], "m")
    expected = {"k": {"a": 1.0, "b": 2.0}, "o": {"a": 5.0}, "n": {"z": 9.0}}
    assert {r.key: r.m for r in once.collect()} == expected
    assert {r.key: r.m for r in store.merge_metric_maps(once, new, ["key"], "m").collect()} == expected


def test_ranking(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = ranking.number_onwards(df, ["v", "id"], 5, buckets=6).orderBy("v", "id").select("number").collect()
    assert [r.number for r in got] == list(range(5, 1005))
    s = ranking.screen_top(df, "v", F.col("v") >= 5, 10, "id")
    assert s.count() == 1000 and s.where("is_candidate").count() == 10 and s.where("reason IS NOT NULL").count() == df.where("v >= 5").count() - 10
    t = ranking.stratified_sample(df.withColumn("g", F.concat(F.lit("g"), "v")), "g", "id", 200)
    assert t.count() == 200 and t.where("g = 'g0'").count() == df.where("v = 0").count()
    assert ranking.stratified_sample(df.withColumn("g", F.concat(F.lit("g"), "v")), "g", "id", 5000).count() == 1000


def test_names_within_names(spark):
    n = spark.createDataFrame([("GPT-4o",), ("x_gpt4o_results",), ("ab",), ("AB",), ("cab",), (None,)], "name string")
    got = {(r.name_l, r.name_r) for r in matching.contained_names(n, n).collect()}
    assert ("GPT-4o", "x_gpt4o_results") in got and ("x_gpt4o_results", "GPT-4o") in got and ("ab", "AB") in got


def test_empty_frames(spark):
    none = spark.createDataFrame([], "model string, v double, k string")
    assert stats.summary(none, ["model"], ["v"]).count() == 0
    assert stats.histogram(none, "v", 5).count() == 0
    assert stats.shares(none, "k").count() == 0
    assert store.latest(none, ["model"], ["v"], ["k"]).count() == 0
    assert ranking.number_onwards(none, ["k"], 1).count() == 0


def test_registry_of_both_tasks(spark):
    """Metrics whose inputs are not there are left out; missing inputs fail as their rules say."""
    registry = me.default_registry()
    assert len(registry.metrics) == 11
    df = spark.createDataFrame([(1, None, [True, None, False, True], None, "[1"), (2, '{"final_score": 0, "analysis": {"dimension_scores": {"style_consistency": 8, "aesthetic_quality": 4}}}', [], [1.0, 0.0], "[]")], "id int, style_reply_task2 string, satisfied array<boolean>, image_vector array<double>, changes_json string")
    df = df.withColumn("render_vector", F.array(F.lit(1.0), F.lit(0.0)))
    got = {(r.id, r.metric): (r.score, r.success) for r in registry.evaluate(df, ["id"]).collect()}
    assert got == {
        (1, "style_consistency_score_task2"): (0.0, False), (1, "xdrfr"): (0.5, True), (1, "siglip_score"): (None, False), (1, "modification_json_token_count"): (0.0, False),
        (2, "style_consistency_score_task2"): (0.6, True), (2, "xdrfr"): (0.0, False), (2, "siglip_score"): (1.0, True), (2, "modification_json_token_count"): (1.0, True),
    }


def test_accuracy_of_answers_is_that_of_the_cascade(spark):
    from graphloom.plans.catalogue import QUERIES

    rows = {tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/qa_pairs.parquet").selectExpr("pair_id", "answer", "visual_anchor", "lower(trim(question_type))").distinct().collect()}
    want = {}
    for _, answer, anchor, kind in rows:
        if kind is not None:
            n, right = want.get(kind, (0, 0))
            want[kind] = (n + 1, right + bool(me.answer_is_correct(answer, anchor, kind)))
    assert {r.kind: (r.total, r.correct) for r in QUERIES["accuracy_of_answers_A3"](spark, "/root/testdata/sf0.001").collect()} == want


def test_score_cache(spark):
    from graphloom.operators.store import ScoreCache

    cache = ScoreCache(spark.createDataFrame([("d", "m", 1.0), ("d", None, 2.0)], "domain string, model string, score double"), ["domain", "model"])
    assert cache.get(domain="d").count() == 2 and [r.score for r in cache.get(domain="d", model=None).collect()] == [2.0]
    assert cache.get().storageLevel.useMemory
    cache.clear()
    with pytest.raises(KeyError):
        cache.get(score="1")
    cache.clear()


def test_axis_bounds_without_span(spark):
    from graphloom.operators.stats import axis_bounds

    r = axis_bounds(spark.createDataFrame([(1.0, 2.0), (None, 2.0)], "x double, y double"), "x", "y").first()
    assert tuple(r) == (0.95, 1.98, 0.15, 0.05, 2.0, 2.0)


def test_differing_parts():
    assert me.differing(list("abcd"), list("axcd")) == (["b"], ["x"])
    assert me.differing(list("aa"), list("aaa")) == ([], ["a"])
    assert me.differing([], list("ab")) == ([], ["a", "b"]) and me.differing(list("ab"), list("ab")) == ([], [])
    assert len({me._letter(n) for n in range(70_000)}) == 70_000 and not any("\ud800" <= me._letter(n) <= "\udfff" for n in range(70_000))
