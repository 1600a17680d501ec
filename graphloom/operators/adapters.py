"""External calls as row functions (G1-G10): recorded replies, and a caller with retries.

The engine has no model, renderer or network. A call is a function from a text
to a text; a recorded run of it is a table of prompt hashes and replies.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CALL = "reply string, error_type string, error_message string, tries int, seconds double"


def prompt_key(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def with_recorded_replies(df: DataFrame, prompt: str, recorded: DataFrame) -> DataFrame:
    """``df`` with the column ``reply``; ``recorded`` (prompt_key, reply). A prompt that was never sent has none; of several replies the greatest counts."""
    one = recorded.groupBy("prompt_key").agg(F.max("reply").alias("reply"))
    return df.withColumn("prompt_key", prompt_key(F.col(prompt))).join(one, "prompt_key", "left").drop("prompt_key")


def call_rows(df: DataFrame, key: str, prompt: str, call: Callable[[str], str], may_retry: Callable[[str, str], bool], tries: int = 3, wait: float = 1.0) -> DataFrame:
    """(key, reply, error_type, error_message, tries, seconds): one row per input row, failed or not.

    A failed call is made again, after 1, 2, 4, ... times ``wait``, while ``may_retry(type, message)`` says so.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch[key], batch[prompt]):
                began, reply, kind, message, n = time.perf_counter(), None, None, None, 0
                while n < tries:
                    n += 1
                    try:
                        reply, kind, message = call(text), None, None
                        break
                    except Exception as e:  # noqa: BLE001 - every failure becomes a row
                        kind, message = type(e).__name__, str(e)
                        if n == tries or not may_retry(kind, message):
                            break
                        time.sleep(wait * 2 ** (n - 1))
                rows.append((k, reply, kind, message, n, time.perf_counter() - began))
            yield pd.DataFrame(rows, columns=[key, "reply", "error_type", "error_message", "tries", "seconds"])

    kind = dict(df.dtypes)[key]
    return df.select(key, prompt).mapInPandas(run, f"{key} {kind}, {CALL}")
