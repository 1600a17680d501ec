"""Reading level of documents: surprisal under n-gram models, mapped by isotonic regression.

For every level an interpolated trigram model is trained on the labelled
documents of that level; the end of a sentence is a token, so the models know
how long sentences of a level are. All tokens of a document are scored by all
models. What is kept of a document is the distribution of its surprisals: mean
and spread under each model, the mean posterior of each level, a histogram of
the level that each token speaks for, and the share and surprisal of sentence
ends. A ridge regression joins these to one score, and isotonic regression maps
the score to the graded level.

The scores used for fitting the regression come from models that have not seen
the document (three folds by a hash of its id). All labelled documents are used
throughout: Spark counts words and trigrams, takes the features of the labelled
documents, sums up the regression and pools the steps of the isotonic one. The
driver gets the words and trigram counts of one model at a time and sums.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.diagrams import small_batches
from ..session import table
from ..staging import Stage

LEVELS, FOLDS = 5, 3
#: A word is known if it is in so many documents.
LEAST_DOCUMENTS = 3
#: So many labelled ids (16 bytes each) or fewer are joined by broadcast, so that texts stay where they are.
BROADCAST_ROWS = 1_000_000
MIN_WORDS = 40
_TOKEN = re.compile(r"[^\W_]+|[.!?]+(?=\s|$)")
_BINS = 10


def tokens_of(text: str) -> list[str]:
    """Words, and one mark for the end of a sentence."""
    return ["." if t[0] in ".!?" else t for t in _TOKEN.findall(text.lower())]


def _before(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one and two before each of concatenated documents; 0 stands before a document."""
    b, a = np.zeros_like(ids), np.zeros_like(ids)
    b[1:], a[2:] = ids[:-1], ids[:-2]
    b[starts[starts < len(ids)]] = 0
    a[starts[starts < len(ids)]] = 0
    second = starts + 1
    second = second[second < len(ids)]
    a[second] = 0
    return b, a


def _sums(key: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their rows of counts."""
    order = np.argsort(key)
    key = key[order]
    first = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0] if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(counts[order], first, axis=0) if len(key) else counts


class Vocabulary:
    """The words that are in enough labelled documents. Model ``k`` < FOLDS knows those that are in enough outside fold k, model FOLDS all."""

    def __init__(self, words: list[str], documents: np.ndarray):
        """``documents``: (words, FOLDS), the documents of each fold that have the word."""
        self.ids = {w: i + 1 for i, w in enumerate(words)}
        self.unknown = len(words) + 1
        rest = documents.sum(1, keepdims=True) - np.c_[documents, np.zeros((len(words), 1), np.int64)]
        self.known = np.zeros((FOLDS + 1, len(words) + 2), bool)
        self.known[:, 1:-1] = (rest >= LEAST_DOCUMENTS).T
        # Three words of less than 21 bits are one number as they stand; of more, by a hash of 64 bits.
        self.base = np.int64(1 << 21) if self.unknown < 1 << 21 else np.int64(0x1E3779B97F4A7C15)

    def encode(self, documents: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of concatenated documents, where each begins and its number of words."""
        get, unknown = self.ids.get, self.unknown
        flat = np.array([get(w, unknown) for d in documents for w in d], np.int64)
        sizes = np.array([len(d) for d in documents], np.int64)
        return flat, np.cumsum(sizes) - sizes, sizes

    def of(self, model: int, flat: np.ndarray) -> np.ndarray:
        """The ids as a model knows them."""
        return np.where(self.known[model][flat], flat, self.unknown)

    def key(self, *ids: np.ndarray) -> np.ndarray:
        out = ids[0]
        for x in ids[1:]:
            out = out * self.base + x
        return out


class _Index:
    """The places of distinct keys, found by hash: open addressing, half of the slots or more are free."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(1, (2 * len(keys)).bit_length()))
        self.slots = np.full(1 << 64 - int(self.shift), -1, np.int32)
        rest, at = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(rest):
            free = self.slots[at] < 0
            self.slots[at[free]] = rest[free]  # one of those that want the same slot gets it
            left = self.slots[at] != rest
            rest, at = rest[left], (at[left] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        x = keys.astype(np.uint64)
        return ((x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, the number of keys for unknown ones."""
        out = np.full(len(keys), len(self.keys), np.int64)
        if not len(self.keys):
            return out
        rest, at = np.arange(len(keys)), self._slot(keys)
        while len(rest):
            got = self.slots[at]
            hit = (got >= 0) & (self.keys[got] == keys[rest])
            out[rest[hit]] = got[hit]
            left = (got >= 0) & ~hit
            rest, at = rest[left], (at[left] + 1) & (len(self.slots) - 1)
        return out


class NgramModels:
    """Interpolated trigram models of all levels: counts in each level of words, pairs of words and trigrams.

    Pickled, it is its trigrams and their counts, compressed; all other tables are sums of them.
    """

    def __init__(self, words: Vocabulary, model: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, counts: np.ndarray):
        """``counts``: (trigrams, levels) of the trigrams a, b, w."""
        self.words, self.model = words, model
        end = words.ids.get(".", 0)
        self.end = end if words.known[model][end] else -1
        self.size = int(words.known[model].sum()) + 1
        order = np.lexsort((w, b, a))
        parts = [np.diff(a[order], prepend=0), b[order], w[order], *counts[order].T]
        self.packed = [zlib.compress(np.ascontiguousarray(x).astype(np.int32 if i < 3 else np.int64).tobytes(), 1) for i, x in enumerate(parts)]
        self._build(a, b, w, counts)

    def _build(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, counts: np.ndarray) -> None:
        self.total = np.maximum(counts.sum(0), 1).astype(np.float32)
        self.w, self.b = (np.stack([np.bincount(x, c, self.words.unknown + 1) for c in counts.T], axis=1).astype(np.float32) for x in (w, b))
        key = self.words.key
        first, second = _sums(key(a, b), counts), _sums(key(b, w), counts)
        pairs = np.unique(np.r_[key(np.zeros(1, np.int64), np.zeros(1, np.int64)), first[0], second[0]])
        self.pairs = _Index(pairs)
        # The last row is for unknown pairs and trigrams.
        self.ab, self.bw = (np.zeros((len(pairs) + 1, LEVELS), np.float32) for _ in "ab")
        for table, (keys, sums) in ((self.ab, first), (self.bw, second)):
            table[self.pairs.find(keys)] = sums
        self.trigrams = _Index(self._trigram(self.pairs.find(key(a, b)), w))
        self.abw = np.r_[counts, np.zeros((1, LEVELS))].astype(np.float32)

    def _trigram(self, pair: np.ndarray, w: np.ndarray) -> np.ndarray:
        return pair * (self.words.unknown + 1) + w

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("words", "model", "end", "size", "packed")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        a, b, w, *counts = (np.frombuffer(zlib.decompress(x), np.int32 if i < 3 else np.int64).astype(np.int64) for i, x in enumerate(self.packed))
        self._build(np.cumsum(a), b, w, np.stack(counts, axis=1).astype(float))

    def encode(self, documents: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat, starts, sizes = self.words.encode(documents)
        return self.words.of(self.model, flat), starts, sizes

    def surprisal(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, levels): in nats, of the unigram and of the interpolated trigram models."""
        b, _ = _before(flat, starts)
        own = self.pairs.find(self.words.key(b, flat))
        # The pair before a word is the one that ends in the word before.
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[starts[starts < len(own)]] = self.pairs.find(np.zeros(1, np.int64))[0]
        whole = self.trigrams.find(self._trigram(before, flat))
        take = lambda table, at: np.take(table, at, axis=0)
        p1 = (take(self.w, flat) + 0.5) / (self.total + 0.5 * self.size)
        p2 = (take(self.bw, own) + 2 * p1) / (take(self.b, b) + 2)
        p3 = (take(self.abw, whole) + 2 * p2) / (take(self.ab, before) + 2)
        return -np.log(p1), -np.log(p3)

    def features(self, documents: list[list[str]]) -> np.ndarray:
        """One row per document (none of them empty): its distribution of surprisals."""
        flat, starts, sizes = self.encode(documents)
        doc = np.repeat(np.arange(len(documents)), sizes)
        n = sizes[:, None].astype(float)
        end = flat == self.end
        grades = np.arange(1, LEVELS + 1)

        def mean(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, starts, axis=0) / n

        out = [mean(end[:, None].astype(float)), np.log1p(mean(end[:, None].astype(float)) * 100)]
        for s in self.surprisal(flat, starts):
            gap = s - s.mean(1, keepdims=True)
            posterior = np.exp(-(s - s.min(1, keepdims=True)))
            posterior /= posterior.sum(1, keepdims=True)
            grade = posterior @ grades
            m = mean(gap)
            bins = np.minimum(((grade - 1) / (LEVELS - 1) * _BINS).astype(int), _BINS - 1)
            shares = np.bincount(doc * _BINS + bins, minlength=len(documents) * _BINS).reshape(-1, _BINS) / n
            out += [mean(s), m, np.sqrt(np.maximum(mean(gap * gap) - m * m, 0)), mean(posterior), mean(grade[:, None]), mean((grade * grade)[:, None]), shares, mean(s * end[:, None])]
        return np.concatenate(out, axis=1)


def pooled(value: np.ndarray, weight: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Neighbouring blocks (mean, weight, first and last score) pooled until no mean is above the next. Blocks pooled in a part of the scores are pooled in the whole too."""
    out: list[tuple[float, float, float, float]] = []
    for block in zip(value.tolist(), weight.tolist(), first.tolist(), last.tolist()):
        out.append(block)
        while len(out) > 1 and out[-2][0] > out[-1][0]:
            (u, m, x, _), (v, n, _, y) = out[-2:]
            out[-2:] = [((u * m + v * n) / (m + n), m + n, x, y)]
    return out


def isotonic(score: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step function with least squares: (scores, fitted levels)."""
    order = np.argsort(score, kind="stable")
    score = score[order]
    blocks = pooled(level[order], np.ones(len(score)), score, score)
    return score, np.repeat([v for v, _, _, _ in blocks], [int(n) for _, n, _, _ in blocks])


class ReadingModel:
    """Everything that scoring needs."""

    def __init__(self, constant: float, models: NgramModels | None = None, fit: tuple[np.ndarray, ...] = ()):
        """``constant``: the score of all documents where too few are labelled. ``fit``: mean and spread of the features, weights, ends of the steps and their levels."""
        self.constant, self.models = constant, models
        if models is not None:
            self.mean, self.spread, self.weights, self.scores, self.steps = fit

    def predict(self, documents: list[list[str]]) -> np.ndarray:
        """The level of each document before rounding; documents must not be empty."""
        if self.models is None:
            return np.full(len(documents), self.constant)
        return np.interp(scaled(self.models.features(documents), self.mean, self.spread) @ self.weights, self.scores, self.steps)


def scaled(rows: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.c_[np.clip((rows - mean) / spread, -5, 5), np.ones(len(rows))]


def _arrays(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]) -> Iterator[np.ndarray]:
    """What ``step`` makes of each part of df, a few arrays of numbers, in the order of the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in step(batches):
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], names=["x"])

    return (np.array(r.x) for r in df.mapInArrow(run, "x array<double>").collect())


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def labelled(docs: DataFrame, labels: DataFrame, stage: Stage) -> DataFrame:
    """(fold, level, tokens) of all labelled documents with words; ``level`` is the mean of the raters, ``tokens`` are joined by blanks.

    Labels without level or document are left out; of repeated documents the largest text counts.
    """
    graded = stage.put(labels.where("level IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("level").alias("level")))
    texts = docs.select("doc_id", "text").where("text IS NOT NULL")
    rows = texts.join(F.broadcast(graded) if graded.count() <= BROADCAST_ROWS else graded, "doc_id").groupBy("doc_id").agg(F.first("level").alias("level"), F.max("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            tokens = pa.array([" ".join(tokens_of(t)) for t in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tokens], names=["fold", "level", "tokens"])

    source = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), F.col("level").cast("double").alias("level"), F.col("text").cast("string").alias("text"))
    return stage.put(source.mapInArrow(run, "fold int, level double, tokens string").where("tokens != ''"))


def vocabulary(rows: DataFrame) -> Vocabulary:
    """The words of enough labelled documents, in order."""
    words = rows.select("fold", F.explode(F.array_distinct(F.split("tokens", " "))).alias("word"))
    counts = words.groupBy("word").agg(*[F.count_if(F.col("fold") == k).alias(f"d{k}") for k in range(FOLDS)])
    found = counts.where(" + ".join(f"d{k}" for k in range(FOLDS)) + f" >= {LEAST_DOCUMENTS}").orderBy("word").toArrow()
    return Vocabulary(found.column(0).to_pylist(), np.stack([found.column(k + 1).to_numpy() for k in range(FOLDS)], axis=1).astype(np.int64))


def trigrams(rows: DataFrame, words: Vocabulary) -> DataFrame:
    """(model, a, b, w, l1 to l5): how often each model's documents of each level have the trigram."""
    shared = rows.sparkSession.sparkContext.broadcast(words)
    names = ["model", "a", "b", "w", *(f"l{k + 1}" for k in range(LEVELS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in small_batches(batches, 2000):
            folds = batch.column(0).to_numpy()
            levels = np.clip(np.floor(batch.column(1).to_numpy() + 0.5), 1, LEVELS).astype(int) - 1
            flat, starts, sizes = own.encode([t.split(" ") for t in batch.column(2).to_pylist()])
            fold, level = np.repeat(folds, sizes), np.repeat(levels, sizes)
            for model in range(FOLDS + 1):
                w = own.of(model, flat)
                b, a = _before(w, starts)
                at = fold != model
                _, first, group = np.unique(own.key(a, b, w)[at], return_index=True, return_inverse=True)
                counts = np.bincount(group * LEVELS + level[at], minlength=len(first) * LEVELS).reshape(-1, LEVELS)
                parts = [x[at][first].astype(np.int32) for x in (a, b, w)]
                columns = [pa.array(np.full(len(first), model, np.int32)), *(pa.array(x) for x in parts), *(pa.array(counts[:, k].copy()) for k in range(LEVELS))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    parts = rows.mapInArrow(run, "model int, a int, b int, w int, " + ", ".join(f"{n} bigint" for n in names[4:]))
    return parts.groupBy(*names[:4]).agg(*[F.sum(n).alias(n) for n in names[4:]])


def ngram_models(counts: DataFrame, words: Vocabulary, model: int) -> NgramModels:
    """Of the counts of all models one model."""
    found = counts.where(F.col("model") == model).drop("model").toArrow()
    a, b, w = (found.column(k).to_numpy().astype(np.int64) for k in range(3))
    return NgramModels(words, model, a, b, w, np.stack([found.column(3 + k).to_numpy() for k in range(LEVELS)], axis=1).astype(float))


def features_of(rows: DataFrame, models: NgramModels, stage: Stage) -> DataFrame:
    """(level, x): the features of labelled documents, staged."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in small_batches(batches, 500):
            if batch.num_rows:
                x = own.features([t.split(" ") for t in batch.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())], names=["level", "x"])

    out = stage.put(rows.mapInArrow(run, "level double, x array<double>"))
    shared.destroy()
    return out


def fitted(rows: DataFrame) -> tuple[np.ndarray, ...]:
    """Ridge and isotonic regression over rows (level, x): mean and spread of the features, weights, ends of the steps and their levels."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                yield np.r_[len(x), x.mean(0), ((x - x.mean(0)) ** 2).sum(0)]

    n, mean, squares = 0.0, 0.0, 0.0
    for part in _arrays(rows, moments):
        k, m, q = part[0], *np.split(part[1:], 2)
        squares = squares + q + (m - mean) ** 2 * (n * k / (n + k))
        mean = mean + (m - mean) * (k / (n + k))
        n += k
    spread = np.sqrt(squares / n) + 1e-9

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                x = scaled(_matrix(batch), mean, spread)
                total = total + np.c_[x.T @ x, x.T @ batch.column(0).to_numpy()]
        if isinstance(total, np.ndarray):
            yield total.ravel()

    size = len(mean) + 1
    total = sum(_arrays(rows, products)).reshape(size, size + 1)
    weights = np.linalg.solve(total[:, :-1] + 30 * np.eye(size), total[:, -1])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(scaled(_matrix(batch), mean, spread) @ weights), batch.column(0)], names=["score", "level"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        own: list[tuple[float, float, float, float]] = []
        for batch in batches:
            score, level = (c.to_numpy() for c in batch.columns)
            own = pooled(*np.r_[np.array(own).reshape(-1, 4), np.c_[level, np.ones(len(level)), score, score]].T)
        yield np.array(own).ravel()

    by_score = rows.mapInArrow(scores, "score double, level double").repartitionByRange("score").sortWithinPartitions("score", "level")
    steps = pooled(*np.concatenate(list(_arrays(by_score, blocks))).reshape(-1, 4).T)
    ends = np.array([(s, v) for v, _, first, last in steps for s in (first, last)])
    return mean, spread, weights, ends[:, 0], ends[:, 1]


def train(docs: DataFrame, labels: DataFrame) -> ReadingModel:
    """Train on all labelled documents.

    Labels without level or document, and documents without words, are left out; raters of a document are averaged.
    """
    stage = Stage(docs.sparkSession, "reading")
    rows = labelled(docs, labels, stage)
    n, mean = rows.agg(F.count("*"), F.avg("level")).first()
    if n < 2 * FOLDS:
        return ReadingModel(float("nan") if mean is None else mean)
    words = vocabulary(rows)
    counts = stage.put(trigrams(rows, words))
    unseen = [features_of(rows.where(F.col("fold") == k), ngram_models(counts, words, k), stage) for k in range(FOLDS)]
    fit = fitted(unseen[0].unionByName(unseen[1]).unionByName(unseen[2]))
    return ReadingModel(mean, ngram_models(counts, words, FOLDS), fit)


def score(docs: DataFrame, model: ReadingModel) -> DataFrame:
    """(doc_id, lang, words, score, level) of every document.

    ``level`` is 1 to 5. A text without words has neither score nor level.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in small_batches(batches, 500):
            documents = [tokens_of(t) if t else [] for t in batch.column(2).to_pylist()]
            words = np.array([sum(t != "." for t in d) for d in documents], np.int32)
            some = np.array([bool(d) for d in documents], bool)
            value = np.full(len(documents), np.nan)
            if some.any():
                value[some] = own.predict([d for d in documents if d])
            missing = np.isnan(value)
            level = np.clip(np.floor(np.where(missing, 1, value) + 0.5), 1, LEVELS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words), pa.array(value, mask=missing), pa.array(level, mask=missing)], names=["doc_id", "lang", "words", "score", "level"])

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id bigint, lang string, words int, score double, level int")


def _scored(spark: SparkSession, sf_dir: str, english: bool) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels")
    model = train(docs, labels)
    return score(docs.where("lang = 'en'") if english else docs, model)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of every English document with at least 40 words."""
    return _scored(spark, sf_dir, True).where(f"words >= {MIN_WORDS}").select("doc_id", "level").distinct()


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and level of every document; the models know English only, so other languages get what its scale makes of them."""
    return _scored(spark, sf_dir, False)


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How demanding the English part of the corpus is: documents and words per level."""
    rows = _scored(spark, sf_dir, True).where(f"words >= {MIN_WORDS}")
    return rows.groupBy("level").agg(F.count("*").alias("documents"), F.sum("words").alias("words"), F.avg("score").alias("mean_score"))


QUERIES = {"p9_found": p9_found, "p9_levels": p9_levels, "p9_profile": p9_profile}
SQL: dict[str, str] = {}
