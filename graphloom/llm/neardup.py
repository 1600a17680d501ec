"""Near-duplicate records with small edits: a byte-position inverted index with count filtering.

A record has a signature of ``POSITIONS`` bytes. Each of its words hashes to a
position and to a byte; the byte at a position is the XOR of the bytes of the
words that fall there, so nearly all positions are empty and a signature is
kept as the list of its positional bytes (position * 256 + byte). The inverted
index lists, for each positional byte, the records that have it.

Where the guarantee comes from: of the positions a record uses, those of its
words that the other one lacks are lost, at most (1 - t) * n of n words if
|common| / |union| >= t; a word that only the other one has spoils a further
position only if it shares it with another word there, so at most as often as
words share positions in a record of such a size (``shared``, the largest number
found in its size class and the two beside it, nearly always 0 or 1). At least
``need`` = positions in use - (1 - t) * n - shared positional bytes are then
common. Among the ``used - need + matches`` globally rarest ones of each of the
two records at least ``matches`` are common. Only those are indexed. The common
ones are tallied per pair, pairs below the guaranteed minimum are dropped, and
the rest are verified on the words themselves. A record for which nothing is
guaranteed is held against all records of its size. No pair is lost.

Frequencies are exact. A posting of more than ``BLOCK`` entries is cut into
blocks that meet block by block, so no posting is the work of one task.
Records with equal word sets are one class before the index is built, so a
group of copies is one entry.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.diagrams import cell_rows, parse_diagram, small_batches
from ..functions.text import folded
from .components import components
from ..session import table
from ..staging import Stage

_MARKUP = re.compile(r"</?[A-Za-z!][^<>\x00]*>")
_WORD = re.compile(r"[^\W_]+")
EMPTY_MD5 = "d41d8cd98f00b204e9800998ecf8427e"

#: Bytes of a signature; a power of two.
POSITIONS = 1 << 23
#: Entries of a posting, or members of a group, that meet in one piece.
BLOCK = 1000
#: A positional byte in more than this share of all entries is looked up in a broadcast table, which so has at most 10,000 rows.
HOT_SHARE = 1e-4


def label_words(text: str | None) -> list[str]:
    """The distinct words of all cell labels, sorted; empty if the XML cannot be read."""
    root = parse_diagram(text)
    if root is None:
        return []
    labels = []
    for _, cell, outer in cell_rows(root):
        label = outer.get("label") if outer is not None else None
        label = cell.get("value") if label is None else label
        if label:
            labels.append(label)
    joined = "\x00".join(labels)
    if "&" in joined:
        joined = html.unescape(joined)
    return sorted(set(_WORD.findall(_MARKUP.sub(" ", joined).lower())))


def signature(words: list[str]) -> list[int]:
    """The positional bytes of a set of words, sorted; all words count, those that share a position by the XOR of their bytes."""
    at: dict[int, int] = {}
    for w in words:
        h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        position, byte = h & (POSITIONS - 1), h >> 23 & 255
        at[position] = at.get(position, 0) ^ byte
    return sorted(p << 8 | b for p, b in at.items())


def word_sets(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(id, words) of every distinct key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets = pa.array([label_words(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["id", "words"])

    source = df.select(df[key].cast("bigint").alias("id"), df[xml].cast("string").alias("xml")).where("id IS NOT NULL")
    return source.mapInArrow(run, "id bigint, words array<string>").groupBy("id").agg(F.max("words").alias("words"))


def signatures(sets: DataFrame) -> DataFrame:
    """(id, n, bytes) of every set: its number of words and its positional bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            words = batch.column(1).to_pylist()
            own = pa.array([signature(w) for w in words], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in words], pa.int32()), own], names=["id", "n", "bytes"])

    return sets.where("size(words) > 0").select("id", "words").mapInArrow(run, "id bigint, n int, bytes array<int>")


def met(members: DataFrame, keys: list[str], stage: Stage, block: int = BLOCK) -> DataFrame:
    """All ordered pairs of members with equal keys; columns of the two end in _a and _b.

    ``members`` has ``id`` besides the keys. A group of more than ``block`` members is cut into blocks by a
    hash of the id, and each pair of blocks is a join key of its own.
    """
    long = members.groupBy(*keys).agg(F.count("*").alias("size")).where(F.col("size") > block).select(*keys, F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    cut = members.join(stage.put(long), keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    cut = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = [c for c in members.columns if c not in keys]
    left = cut.select(*keys, F.col("own").alias("i"), F.col("other").alias("j"), *[F.col(c).alias(f"{c}_a") for c in rest])
    right = cut.select(*keys, F.col("other").alias("i"), F.col("own").alias("j"), *[F.col(c).alias(f"{c}_b") for c in rest])
    return left.join(right, [*keys, "i", "j"])


def classes_of(sets: DataFrame) -> DataFrame:
    """(id, rep): records with equal, non-empty word sets share the smallest id of the class."""
    keyed = sets.where("size(words) > 0").select("id", F.sha2(F.array_join("words", " "), 256).alias("set_key"))
    rep = keyed.groupBy("set_key").agg(F.min("id").alias("rep"))
    return keyed.join(rep, "set_key").select("id", "rep")


def _by_rarity(coded: DataFrame) -> DataFrame:
    """(id, n, used, bytes): the positional bytes of each record, globally rarest first."""
    entries = coded.select("id", "n", F.explode("bytes").alias("key"))
    counts = entries.groupBy("key").agg(F.count("*").alias("df"))
    least = (coded.agg(F.sum(F.size("bytes"))).first()[0] or 0) * HOT_SHARE
    hot = F.broadcast(counts.where(F.col("df") > least).select("key", F.col("df").alias("hot")))  # at most 1 / HOT_SHARE rows
    marked = entries.join(hot, "key", "left")
    cold = marked.where("hot IS NULL").drop("hot").join(counts.where(F.col("df") <= least), "key")
    ranked = marked.where("hot IS NOT NULL").withColumnRenamed("hot", "df").unionByName(cold)
    return ranked.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("bytes")).withColumn("used", F.size("bytes"))


def similar_sets(sets: DataFrame, threshold: float, stage: Stage, matches: int = 2, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: pairs of ids of different word sets with similarity >= threshold, each once.

    ``sets`` (id, words): every id once, words distinct. Empty sets match nothing.
    """
    coded = stage.put(signatures(sets))
    size_class = F.expr(f"int(floor(ln(n) / ln({1 / threshold}D) + 1e-9D))")
    spoilt = coded.groupBy(size_class.alias("own")).agg(F.max(F.col("n") - F.size("bytes")).alias("most"))
    spoilt = spoilt.select(F.explode(F.expr("array(own - 1, own, own + 1)")).alias("class"), "most").groupBy("class").agg(F.max("most").alias("spoilt"))
    ordered = stage.put(
        _by_rarity(coded).withColumn("class", size_class)
        .join(F.broadcast(stage.put(spoilt)), "class")  # a row for each power of 1 / threshold
        .withColumn("need", F.expr(f"used - int(floor({1 - threshold}D * n + 1e-9D)) - spoilt"))
        .select("id", "n", "used", "need", F.expr(f"least({matches}, need)").alias("floor"), F.expr("if(need > 0, slice(transform(bytes, x -> x.key), 1, used - need + least(2, need)), array())".replace("2", str(matches))).alias("prefix"))
    )
    index = ordered.select("id", "n", "used", "floor", F.posexplode("prefix").alias("at", "key"))
    pairs = met(index, ["key"], stage, block)
    smaller = F.struct("n_a", "id_a") < F.struct("n_b", "id_b")
    # What can still be common: one, those before it, and those after it in both; of all used ones all but those that differ.
    most = F.least("at_a", "at_b") + F.least(F.col("used_a") - F.col("at_a"), F.col("used_b") - F.col("at_b"))
    edits = F.expr(f"int(floor({(1 - threshold) / (1 + threshold)}D * (n_a + n_b) + 1e-9D))")
    close = smaller & (F.col("n_a") >= F.lit(threshold) * F.col("n_b") - 1e-9) & (most >= F.greatest("used_a", "used_b") - edits)
    tally = (
        pairs.where(close).groupBy("id_a", "id_b")
        .agg(F.count("*").alias("common"), F.min(F.least("floor_a", "floor_b")).alias("floor"))
        .where("common >= floor").select("id_a", "id_b")
    )
    # Without a guarantee: all records of a size that could be similar.
    sized = coded.select("id", "n")
    blind = ordered.where("need <= 0").select(F.col("id").alias("x"), F.col("n").alias("nx"), F.explode(F.expr(f"sequence(int(ceil({threshold}D * n - 1e-9D)), int(floor(n / {threshold}D + 1e-9D)))")).alias("n"))
    rest = blind.join(sized, "n").where("x != id").select(F.least("x", "id").alias("id_a"), F.greatest("x", "id").alias("id_b"))
    a, b = (sets.select(F.col("id").alias(f"id_{s}"), F.col("words").alias(f"words_{s}")) for s in "ab")
    both = tally.unionByName(rest.distinct()).join(a, "id_a").join(b, "id_b").withColumn("common", F.size(F.array_intersect("words_a", "words_b")))
    return both.where(F.expr(f"common >= {threshold}D * (size(words_a) + size(words_b) - common) - 1e-9D")).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def image_hashes(diagrams: DataFrame, sample_meta: DataFrame) -> DataFrame:
    """(id, hash): each diagram with the usable image hashes of its sample."""
    hashes = sample_meta.select(folded(F.col("domain")).alias("domain"), F.col("sample_id"), folded(F.col("image_hash_md5")).alias("hash")).where(~F.col("hash").isin("", EMPTY_MD5)).distinct()
    samples = diagrams.select(F.col("diagram_id").cast("bigint").alias("id"), folded(F.col("domain")).alias("domain"), F.col("sample_id")).distinct()
    return samples.join(hashes, ["domain", "sample_id"]).select("id", "hash").where("id IS NOT NULL").distinct()


def near_duplicates(spark: SparkSession, diagrams: DataFrame, sample_meta: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame, DataFrame, Stage]:
    """(classes, links between class representatives, hashes, stage).

    A NULL, empty or broken XML has no words and can match by hash only. NULL ids
    are left out, repeated rows count once, extra columns are not read.
    """
    stage = Stage(spark, "neardup")
    sets = stage.put(word_sets(diagrams, "diagram_id", "xml_content"))
    classes = stage.put(classes_of(sets))
    reps = sets.join(classes.where("id = rep").select("id"), "id", "left_semi")
    return classes, stage.put(similar_sets(stage.put(reps), threshold, stage)), stage.put(image_hashes(diagrams, sample_meta)), stage


def _pairs_within(members: DataFrame, group: str, stage: Stage) -> DataFrame:
    """All pairs a < b of a group's members; for results whose definition asks for them."""
    return met(members.select(group, "id"), [group], stage).where("id_a < id_b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of near-duplicate diagrams, copies expanded as the definition asks."""
    classes, links, hashes, stage = near_duplicates(spark, table(spark, sf_dir, "diagrams"), table(spark, sf_dir, "sample_meta"))
    a, b = (classes.select(F.col("rep").alias(s), F.col("id").alias(f"id_{s}")) for s in "ab")
    across = links.join(a, "a").join(b, "b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
    pairs = across.unionByName(_pairs_within(classes, "rep", stage)).unionByName(_pairs_within(hashes, "hash", stage))
    return pairs.distinct().select(F.col("a").alias("diagram_id_a"), F.col("b").alias("diagram_id_b"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every diagram with its group (smallest id), its class of equal word sets and the number of links of that class."""
    diagrams = table(spark, sf_dir, "diagrams")
    classes, links, hashes, stage = near_duplicates(spark, diagrams, table(spark, sf_dir, "sample_meta"))
    # Records are what ties ids together: a class, a verified link, a hash.
    ties = classes.select(F.concat(F.lit("c"), "rep").alias("rec"), F.col("id").alias("val"))
    ties = ties.unionByName(hashes.select(F.concat(F.lit("h"), "hash").alias("rec"), F.col("id").alias("val")))
    ties = ties.unionByName(links.select(F.concat_ws("-", F.lit("l"), "a", "b").alias("rec"), F.explode(F.array("a", "b")).alias("val")))
    groups = components(ties, stage)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    ids = diagrams.select(F.col("diagram_id").alias("id")).where("id IS NOT NULL").distinct()
    out = ids.join(groups.select(F.col("val").alias("id"), "label"), "id", "left").join(classes, "id", "left").join(degree, "rep", "left")
    return out.select(F.col("id").alias("diagram_id"), F.coalesce("label", "id").alias("group_id"), F.coalesce("rep", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups}
SQL: dict[str, str] = {}
