from pyspark.sql import functions as F

from graphloom.operators import adapters


def test_calls_retry_only_where_told(spark):
    def call(text):
        if text == "slow":
            raise TimeoutError("timed out")
        if text == "bad":
            raise KeyError("no key")
        return text.upper()

    df = spark.createDataFrame([(1, "ok"), (2, "slow"), (3, "bad")], "id bigint, prompt string")
    rows = adapters.call_rows(df, "id", "prompt", call, lambda kind, message: kind == "TimeoutError", tries=3, wait=0.001)
    assert {(r.id, r.reply, r.error_type, r.tries) for r in rows.collect()} == {(1, "OK", None, 1), (2, None, "TimeoutError", 3), (3, None, "KeyError", 1)}


def test_recorded_replies(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id bigint, p string")
    recorded = spark.createDataFrame([("a", "x"), ("a", "y")], "p string, reply string").select(adapters.prompt_key(F.col("p")).alias("prompt_key"), "reply")
    assert {(r.id, r.reply) for r in adapters.with_recorded_replies(df, "p", recorded).collect()} == {(1, "y"), (2, None), (3, None)}
