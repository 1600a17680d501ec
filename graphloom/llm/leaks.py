"""Evaluation texts that leak into training text: suffix arrays over shards of the corpus.

The corpus is read once: each task cuts its documents into shards of a bounded
number of words and builds a suffix array over the words of a shard, sorted to
the full depth (prefix doubling, in which only suffixes that are still equal are
sorted again). Shards are written to the shared folder and serve any number of
items.

The items are the stated query set. They are a table of blocks of a bounded
number of words, and each block meets each shard: every suffix of every item is
found by binary search, all at once, suffixes with equal first words together.
From each place of its range that a longer match does not contain already (the
words before differ), the match is followed to its end; the longest one of each
document and item is kept. The documents are not shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.diagrams import small_batches
from ..session import table
from ..staging import Stage

MIN_WORDS = 13
SHARD_WORDS = 400_000
#: Words of items in a block.
BLOCK_WORDS = 2_000_000
#: Places that are followed at once.
AT_ONCE = 2_000_000

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order; what ends first comes first."""
    n = len(sequence)
    order = np.argsort(sequence, kind="stable")
    first = np.concatenate([[True], sequence[order][1:] != sequence[order][:-1]]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))  # where the suffixes that are equal so far begin
    step = 1
    while True:
        last = np.concatenate([first[1:], [True]])[:n]
        open_ = np.flatnonzero(~(first & last))
        if not len(open_):
            return order
        at = order[open_]
        further = np.where(at + step < n, rank[np.minimum(at + step, n - 1)], -1)
        sort = np.lexsort((further, rank[at]))
        at, further, group = at[sort], further[sort], rank[at][sort]
        order[open_] = at
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (further[1:] != further[:-1])])
        first[open_] = new
        rank[at] = open_[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        step *= 2


def search(sequence: np.ndarray, suffixes: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query row the range of suffixes (low, high) that start with it. ``sequence`` is padded behind its end."""
    width = queries.shape[1]
    columns = np.arange(width)

    def bound(after: bool) -> np.ndarray:
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(suffixes), np.int64)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high) // 2
            have = sequence[suffixes[np.minimum(mid, len(suffixes) - 1)][:, None] + columns]
            differs = have != queries
            first = differs.argmax(1)
            rows = np.arange(len(queries))
            equal = ~differs[rows, first]
            less = have[rows, first] < queries[rows, first]
            right = open_ & (less | equal & after)
            low = np.where(right, mid + 1, low)
            high = np.where(open_ & ~right, mid, high)

    return bound(False), bound(True)


class Shard:
    """Documents of a shard as word numbers with their suffix array.

    ``sequence`` has the documents one after another, each closed by a number of its own above all words.
    """

    def __init__(self, ids: np.ndarray, ends: np.ndarray, words: list[str], sequence: np.ndarray, suffixes: np.ndarray):
        self.ids, self.ends, self.words, self.sequence, self.suffixes = ids, ends, words, sequence, suffixes

    @classmethod
    def build(cls, docs: list[tuple[int, list[str]]]) -> Shard:
        numbers: dict[str, int] = {}
        code, ends = [], []
        for n, (_, ws) in enumerate(docs):
            code.extend([numbers.setdefault(w, len(numbers)) for w in ws])
            ends.append(len(code))
            code.append(-1 - n)
        base = np.array(code, np.int64)
        sequence = np.where(base < 0, len(numbers) - 1 - base, base)
        return cls(np.array([i for i, _ in docs], np.int64), np.array(ends, np.int32), list(numbers), sequence.astype(np.int32), suffix_array(sequence).astype(np.int32))

    FIELDS = ("ids", "ends", "words", "sequence", "suffixes")

    def packed(self) -> tuple[bytes, ...]:
        return self.ids.tobytes(), self.ends.tobytes(), "\n".join(self.words).encode("utf-8", "surrogatepass"), self.sequence.tobytes(), self.suffixes.tobytes()

    @classmethod
    def unpacked(cls, ids: bytes, ends: bytes, words: bytes, sequence: bytes, suffixes: bytes) -> Shard:
        text = bytes(words).decode("utf-8", "surrogatepass")
        return cls(np.frombuffer(ids, np.int64), np.frombuffer(ends, np.int32), text.split("\n") if text else [], np.frombuffer(sequence, np.int32), np.frombuffer(suffixes, np.int32))

    def leaks(self, items: list[tuple[int, list[str]]], min_words: int) -> list[tuple[int, int, int, int, int]]:
        """(doc, item, longest match in words, word position in the document, in the item), one row per pair."""
        numbers = {w: i for i, w in enumerate(self.words)}
        line, owner = [], []  # all items one after another; -1: a word that the shard lacks, -2: before an item
        grams: dict[tuple[int, ...], list[int]] = {}  # the suffixes by their first words, which are looked up once
        for n, (_, ws) in enumerate(items):
            line.append(-2)
            start, gap = len(line), -1
            line.extend([numbers.get(w, -1) for w in ws])
            owner.extend([n] * (len(ws) + 1))
            for i in range(len(ws)):
                gap = i if line[start + i] < 0 else gap
                if i - gap >= min_words:
                    grams.setdefault(tuple(line[start + i - min_words + 1 : start + i + 1]), []).append(start + i - min_words + 1)
        if not grams or len(self.sequence) <= min_words:
            return []
        closed = np.concatenate([np.array(line, np.int64), [-2]])
        padded = np.concatenate([self.sequence.astype(np.int64), np.full(min_words, self.sequence.max() + 1)])
        low, high = search(padded, self.suffixes, np.array(list(grams), np.int64))
        owners, starts = np.array(owner), np.concatenate([[0], self.ends[:-1] + 1])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        there: list[np.ndarray] = []
        here: list[np.ndarray] = []
        waiting = 0

        def follow() -> None:
            nonlocal waiting
            place, own = np.concatenate(there), np.concatenate(here)
            there.clear(), here.clear()
            waiting = 0
            length, open_ = np.full(len(place), min_words, np.int64), np.arange(len(place))
            while len(open_):
                at = place[open_] + length[open_]
                equal = padded[np.minimum(at, len(padded) - 1)] == closed[own[open_] + length[open_]]
                open_ = open_[equal]
                length[open_] += 1
            doc, item = np.searchsorted(self.ends, place), owners[own]
            order = np.lexsort((own, place, -length, item, doc))
            doc, item = doc[order], item[order]
            top = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
            for d, n, k in zip(doc[top].tolist(), item[top].tolist(), order[top].tolist()):
                found = (-int(length[k]), int(place[k]), int(own[k]))
                best[d, n] = min(found, best.get((d, n), found))

        for lo, hi, own in zip(low.tolist(), high.tolist(), grams.values()):
            if lo == hi:
                continue
            places = self.suffixes[lo:hi].astype(np.int64)
            before = np.where(places > 0, padded[places - 1], -3)
            own_ = np.array(own)
            own_before = closed[own_ - 1]
            for value in np.unique(own_before).tolist():
                mine = own_[own_before == value]
                begins = places if value < 0 else places[before != value]
                for at in range(0, len(begins), max(1, AT_ONCE // len(mine))):
                    part = begins[at : at + max(1, AT_ONCE // len(mine))]
                    there.append(np.repeat(part, len(mine)))
                    here.append(np.tile(mine, len(part)))
                    waiting += len(part) * len(mine)
                    if waiting >= AT_ONCE:
                        follow()
        if there:
            follow()
        first = {n: int(np.searchsorted(owners, n)) + 1 for n in {n for _, n in best}}
        return [(int(self.ids[d]), items[n][0], -length, place - int(starts[d]), own - first[n]) for (d, n), (length, place, own) in best.items()]


_SHARD_DDL = "ids binary, ends binary, words binary, sequence binary, suffixes binary"
_DDL = "doc_id bigint, item_id bigint, words int, doc_word int, item_word int"


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(df[key].cast("bigint").alias("id"), df[text].cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")


def shards_of(docs: DataFrame, min_words: int, shard_words: int) -> DataFrame:
    """(ids, ends, words, sequence, suffixes), one row per shard; documents (id, text) with fewer than ``min_words`` words are in none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(docs: list[tuple[int, list[str]]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in Shard.build(docs).packed()], names=list(Shard.FIELDS))

        shard, n = [], 0
        for batch in small_batches(batches):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws = words_of(t)
                if len(ws) < min_words:
                    continue
                shard.append((i, ws))
                n += len(ws)
                if n >= shard_words:
                    yield packed(shard)
                    shard, n = [], 0
        if shard:
            yield packed(shard)

    return docs.mapInArrow(run, _SHARD_DDL)


def blocks_of(items: DataFrame, min_words: int, block_words: int) -> DataFrame:
    """(item_ids, item_words), one row per block of items (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(block: list[tuple[int, list[str]]]) -> pa.RecordBatch:
            lines = "\n".join(" ".join(ws) for _, ws in block).encode("utf-8", "surrogatepass")
            return pa.RecordBatch.from_arrays([pa.array([np.array([i for i, _ in block], np.int64).tobytes()], pa.binary()), pa.array([lines], pa.binary())], names=["item_ids", "item_words"])

        block, size = [], 0
        for batch in small_batches(batches):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws = words_of(t)
                if len(ws) < min_words:
                    continue
                if block and size + len(ws) > block_words:
                    yield packed(block)
                    block, size = [], 0
                block.append((i, ws))
                size += len(ws)
        if block:
            yield packed(block)

    return items.mapInArrow(run, "item_ids binary, item_words binary")


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, min_words: int = MIN_WORDS, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Longest match of each (document, item) with at least ``min_words`` consecutive common words; of several the first in the document, then in the item.

    NULL, empty and shorter texts match nothing; rows with a NULL key are left
    out; of a repeated key the longest match counts. Other columns are not read.
    """
    stage = Stage(docs.sparkSession, "leaks")
    shards = stage.put(shards_of(_keyed(docs, key, text), min_words, shard_words))
    distinct = _keyed(items, item_key, item_text).distinct()
    # As few partitions as the words ask for: a block ends with its partition.
    size = distinct.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = stage.put(blocks_of(distinct.repartition(int(size // (4 * block_words)) + 1, "id"), min_words, block_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                *shard, item_ids, item_words = (c[r].as_buffer() for c in batch.columns)
                texts = bytes(item_words).decode("utf-8", "surrogatepass").split("\n")
                rows = Shard.unpacked(*shard).leaks(list(zip(np.frombuffer(item_ids, np.int64).tolist(), [t.split(" ") for t in texts])), min_words)
                columns = list(zip(*rows)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "words", "doc_word", "item_word"])

    # Each block of the query set meets each shard.
    out = shards.crossJoin(blocks).mapInArrow(run, _DDL)
    best = F.max(F.struct("words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.words", (-F.col("best.d")).alias("doc_word"), (-F.col("best.i")).alias("item_word"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items they contain."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest verbatim match of each such pair and where it stands."""
    return _leaks(spark, sf_dir)


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without those that contain an item."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "domain").join(_leaks(spark, sf_dir).select("doc_id").distinct(), "doc_id", "left_anti")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with the number of documents that contain it and the longest match."""
    hits = _leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("longest"))
    items = table(spark, sf_dir, "eval_items").select("item_id", "task").distinct()
    return items.join(hits, "item_id", "left").fillna(0, ["documents", "longest"])


QUERIES = {"p8_found": p8_found, "p8_matches": p8_matches, "p8_clean": p8_clean, "p8_items": p8_items}
#: All windows of 13 words of both sides, joined.
_WINDOWS = r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
e AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dg AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
eg AS (SELECT item_id, i AS j, array_to_string(w[i:i + 12], ' ') AS g FROM e, unnest(range(1, len(w) - 11)) AS t(i)),
m AS (SELECT doc_id, item_id, i, j FROM dg JOIN eg USING (g)),
r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run FROM m),
l AS (SELECT doc_id, item_id, i - j AS diagonal, run, count(*) + 12 AS words, min(i) - 1 AS doc_word, min(j) - 1 AS item_word FROM r GROUP BY ALL),
best AS (SELECT doc_id, item_id, words::INTEGER AS words, doc_word::INTEGER AS doc_word, item_word::INTEGER AS item_word FROM l
  QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY words DESC, doc_word, item_word) = 1)
"""
SQL = {
    "p8_matches": _WINDOWS + "SELECT * FROM best",
    "p8_clean": _WINDOWS + "SELECT doc_id, source, domain FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM best)",
    "p8_items": _WINDOWS + "SELECT item_id, task, count(b.doc_id) AS documents, coalesce(max(words), 0)::INTEGER AS longest FROM (SELECT DISTINCT item_id, task FROM eval_items) i LEFT JOIN best b USING (item_id) GROUP BY item_id, task",
    "p8_found": r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
e AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
eg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g FROM e, unnest(range(1, len(w) - 11)) AS t(i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)"""
}
