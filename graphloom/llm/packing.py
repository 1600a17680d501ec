"""Filling containers of fixed capacity: shortest pack first over the histogram of lengths.

Only the histogram reaches the driver: at most ``capacity`` rows, whatever the
number of documents. It is packed longest length first; a length goes into the
shortest packs (those with the most room), many equal packs in one step, and
new packs are opened only where none has room. The result is a list of packing
patterns with counts. Documents find their pattern by the rank they have among
the documents of their length, so texts never move.

A text longer than the capacity is cut into full pieces and a rest; no other is
cut. A NULL, empty or otherwise tokenless text takes no container.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.diagrams import small_batches
from ..session import table
from ..staging import Stage

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Hash ranges in which the documents of a length are ranked, so that a common length is no hot task.
RANGES = 64


@cache
def encoding(path: str):
    """The public tokenizer whose rank file is at ``path``; loaded once a worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("graphloom", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, tokens) of every row, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(tokenizer).encode_ordinary
        for batch in small_batches(batches):
            lengths = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64())], names=["id", "tokens"])

    return df.select(df[key].cast("bigint").alias("id"), df[text].cast("string").alias("text")).mapInArrow(run, "id bigint, tokens bigint")


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """[(number of containers, the lengths in each, longest first)]."""
    by_room: dict[int, dict[tuple[int, ...], int]] = {}

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        of_room = by_room.setdefault(room, {})
        of_room[pattern] = of_room.get(pattern, 0) + n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max(by_room, default=-1)
            if room < length:
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    put(capacity - each * length, (length,) * each, full)
                if rest:
                    put(capacity - rest * length, (length,) * rest, 1)
                break
            for pattern in list(by_room[room]):
                n = min(left, by_room[room][pattern])
                by_room[room][pattern] -= n
                if not by_room[room][pattern]:
                    del by_room[room][pattern]
                put(room - length, (*pattern, length), n)
                left -= n
                if not left:
                    break
            if not by_room[room]:
                del by_room[room]
    return [(n, pattern) for room in sorted(by_room) for pattern, n in by_room[room].items()]


def slots_of(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """For each place of each pattern: length, first rank among that length, number, first container, offset in the container."""
    rows, used, container = [], {}, 0
    for n, pattern in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, used.get(length, 0), n, container, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        container += n
    table_ = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "count", "container", "offset"), table_.T))


def pack(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, piece, pieces, tokens, container_id, start): every text, or every piece of one above the capacity, with its place.

    Repeated rows are packed as often as they come. Extra columns are not read.
    """
    spark = df.sparkSession
    stage = Stage(spark, "packing")
    lengths = stage.put(token_lengths(df, key, text, tokenizer))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)).cast("int")
    cut = lengths.withColumn("pieces", pieces).select(
        "id", F.explode(F.sequence(F.lit(1), "pieces")).alias("piece"), "pieces", F.col("tokens").alias("all_tokens")
    ).withColumn("tokens", F.least(F.lit(capacity), F.col("all_tokens") - (F.col("piece") - 1) * capacity).cast("int")).drop("all_tokens")
    ranged = cut.withColumn("range", F.pmod(F.xxhash64("id", "piece"), F.lit(RANGES)).cast("int"))
    sized = ranged.where("tokens > 0").groupBy("tokens", "range").agg(F.count("*").alias("n"))
    found = sized.collect()  # at most capacity x RANGES rows
    histogram: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for r in sorted(found, key=lambda r: (r.tokens, r.range)):
        before[r.tokens, r.range] = histogram.get(r.tokens, 0)
        histogram[r.tokens] = histogram.get(r.tokens, 0) + r.n
    slots = slots_of(pack_histogram(histogram, capacity))
    # Both tables are bounded by the capacity; they are looked up by binary search.
    start_keys = np.array(sorted((t * RANGES + r, n) for (t, r), n in before.items()), np.int64).reshape(-1, 2)
    shared = spark.sparkContext.broadcast((start_keys, slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, slot = shared.value
        wide = np.int64(1) << 40
        order = slot["length"] * wide + slot["rank"]
        for batch in batches:
            ids, piece, of, tokens, range_, rank = (batch.column(i) for i in range(6))
            t, g, r = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (tokens, range_, rank))
            some = t > 0
            container, offset = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
            if some.any():
                at = np.searchsorted(keys[:, 0], t[some] * RANGES + g[some])
                whole = keys[at, 1] + r[some] - 1
                i = np.searchsorted(order, t[some] * wide + whole, side="right") - 1
                container[some] = slot["container"][i] + whole - slot["rank"][i]
                offset[some] = slot["offset"][i]
            yield pa.RecordBatch.from_arrays(
                [ids, piece, of, tokens, pa.array(container, mask=~some), pa.array(offset.astype(np.int32), mask=~some)],
                names=["id", "piece", "pieces", "tokens", "container_id", "start"],
            )

    rank = F.row_number().over(Window.partitionBy("tokens", "range").orderBy("id", "piece")).cast("bigint")
    ranked = ranged.withColumn("rank", rank).select("id", "piece", "pieces", "tokens", "range", "rank")
    return ranked.mapInArrow(run, "id bigint, piece int, pieces int, tokens int, container_id bigint, start int")


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, or piece of one, with its container and where it starts there."""
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, their fill, and the least number that any packing could need."""
    packed = p7_pack(spark, sf_dir)
    total = packed.agg(
        F.count("container_id").alias("items"), F.coalesce(F.max("container_id") + 1, F.lit(0)).alias("containers"), F.sum("tokens").alias("tokens"), F.count_if(F.col("container_id").isNull()).alias("without_tokens")
    )
    return total.withColumn("least_containers", F.ceil(F.col("tokens") / CAPACITY)).withColumn("fill", F.try_divide(F.col("tokens"), F.col("containers") * CAPACITY))


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of any packing: all documents are placed, no container is overfull, its items follow each other without gaps, and only texts over the capacity are split."""
    packed = p7_pack(spark, sf_dir)
    of_container = packed.where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("tokens").alias("tokens"), F.max(F.col("start") + F.col("tokens")).alias("reach"))
    bad = of_container.agg(F.count_if(F.col("tokens") > CAPACITY).alias("overfull"), F.count_if(F.col("reach") != F.col("tokens")).alias("with_gaps"))
    of_document = packed.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    rest = of_document.agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= CAPACITY)).alias("split_needlessly"))
    return rest.crossJoin(F.broadcast(bad))  # one row each


QUERIES = {"p7_pack": p7_pack, "p7_report": p7_report, "p7_invariants": p7_invariants}
SQL = {"p7_invariants": "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS split_needlessly, 0::BIGINT AS overfull, 0::BIGINT AS with_gaps FROM documents"}
