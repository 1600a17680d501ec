"""The counting rule on answers in any letters."""

from graphloom.functions.metrics import answer_is_correct
from graphloom.plans import catalogue

ANSWERS = ["There are 7.", "一共有7个节点。", "“7” boxes", "’7’", "seven – no number", "图中有 17 个", "Es sind 1.7 Kästen", "7", "n° 07", "没有", "٧"]


def test_answers_in_any_letters_are_scored(spark, tmp_path):
    rows = [(7 + 20 * i, a, "Counting ") for i, a in enumerate(ANSWERS)] + [(1000, "7", "other"), (1001, None, "counting")]
    spark.createDataFrame(rows + rows[:2], "pair_id bigint, answer string, question_type string").write.parquet(f"{tmp_path}/qa_pairs.parquet")
    got = {r.pair_id: r.correct for r in catalogue.QUERIES["counting_answer_M11"](spark, str(tmp_path)).collect()}
    assert got == {7 + 20 * i: answer_is_correct(a, "7", "counting") for i, a in enumerate(ANSWERS)}
    assert got[27] and got[47] and not got[7 + 20 * 5]
