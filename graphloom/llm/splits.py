"""Splits that keep related records together.

Records and the values they share (sample, author, paper) form a bipartite
graph. Minimum labels pass from values to records and back until nothing
changes; the label is the group. All instructions of a sample share the sample,
so the graph has one record per sample, however many instructions it has.

Groups then go to splits so that each split has its share of the rows and, as
far as possible, of every difficulty level. The ``SINGLE`` largest groups are
placed one by one, largest first; what is smaller than all of these falls into
hash buckets by its main level, and a bucket is placed as one. Each of the
``LEVELS`` most frequent levels is a stratum of its own, the rest are one. So
what the driver sees is bounded, whatever the number of groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import folded, known
from .components import components
from ..session import table
from ..staging import Stage
from .sampling import level_of

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Groups placed one by one, hash buckets of the smaller ones per main level, and levels held in proportion.
SINGLE, BUCKETS, LEVELS = 10_000, 256, 30


def sample_value(domain: str = "domain", sample: str = "sample_id"):
    return F.concat_ws("/", F.coalesce(folded(F.col(domain)), F.lit("")), F.coalesce(folded(F.col(sample)), F.lit("")))


def groups(spark: SparkSession, instructions: DataFrame, sample_meta: DataFrame, stage: Stage) -> DataFrame:
    """(instruction_key, group_key) of every distinct instruction.

    Blank and placeholder authors and papers tie nothing. A NULL or blank sample
    or domain counts as an empty text. Rows with a NULL key are left out. A key
    that comes with several samples or authors is tied to all of them.
    """
    rows = instructions.select(F.col("instruction_key").alias("key"), sample_value().alias("sample"), known(F.col("author")).alias("author")).where("key IS NOT NULL").distinct()
    papers = sample_meta.select(sample_value().alias("sample"), known(F.col("paper_id")).alias("val")).where("val IS NOT NULL").distinct()
    rows = stage.put(rows)
    samples = rows.select("sample").distinct()
    ties = rows.select(F.col("sample").alias("rec"), F.col("author").alias("val")).where("val IS NOT NULL")
    ties = ties.unionByName(samples.join(papers, "sample").select(F.col("sample").alias("rec"), "val"))
    ties = ties.unionByName(samples.select(F.col("sample").alias("rec"), F.col("sample").alias("val")))
    several = rows.groupBy("key").agg(F.collect_set("sample").alias("samples")).where("size(samples) > 1")
    ties = ties.unionByName(several.select(F.concat(F.lit("\x00"), F.col("key").cast("string")).alias("rec"), F.explode("samples").alias("val")))
    label = components(ties, stage)
    found = rows.select("key", F.col("sample").alias("val")).distinct().join(label, "val")
    return found.groupBy(F.col("key").alias("instruction_key")).agg(F.min("label").alias("group_key"))


def place(counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """The split of each item, largest items first; ``counts`` (items, levels).

    Each item goes where the squared gaps to the wanted size and level counts, each over the wanted count, become least;
    so a group too large for a small split goes to the large one.
    """
    total = counts.sum(0)
    want = np.outer(shares, np.append(total, total.sum()))
    have, scale = np.zeros_like(want), 1.0 / np.sqrt(np.maximum(want, 1.0))
    out = np.zeros(len(counts), int)
    for i in np.argsort(-counts.sum(1), kind="stable"):
        item = np.append(counts[i], counts[i].sum())
        gain = (((have + item - want) * scale) ** 2 - ((have - want) * scale) ** 2).sum(1)
        out[i] = int(np.argmin(gain))
        have[out[i]] += item
    return out


def assign(rows: DataFrame, stage: Stage, shares: dict[str, float] | None = None, single: int = SINGLE) -> DataFrame:
    """rows (instruction_key, group_key, level) with the column ``split``; all rows of a group in one split."""
    shares = shares or SPLITS
    spark = rows.sparkSession
    named = rows.where("level IS NOT NULL").groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "level").limit(LEVELS).select("level").collect()
    strata = spark.createDataFrame([(r.level, i + 2) for i, r in enumerate(named)], "level string, own int")
    stratum = F.when(F.col("level").isNull(), 0).otherwise(F.coalesce("own", F.lit(1)))
    per = stage.put(rows.join(F.broadcast(strata), "level", "left").withColumn("stratum", stratum).groupBy("group_key", "stratum").agg(F.count("*").alias("n")))
    sizes = stage.put(per.groupBy("group_key").agg(F.sum("n").alias("n"), F.max_by("stratum", F.struct("n", "stratum")).alias("main")))
    large = stage.put(sizes.orderBy(F.desc("n"), "group_key").limit(single).select("group_key", F.col("group_key").alias("item")))
    small = sizes.join(F.broadcast(large.select("group_key")), "group_key", "left_anti")  # at most SINGLE rows
    small = small.select("group_key", F.concat_ws(":", F.lit("\x00"), "main", F.pmod(F.xxhash64("group_key"), F.lit(BUCKETS))).alias("item"))
    items = stage.put(large.unionByName(small))
    found = per.join(items, "group_key").groupBy("item", "stratum").agg(F.sum("n").alias("n")).collect()  # at most (SINGLE + BUCKETS * (LEVELS + 2)) * (LEVELS + 2)
    names = sorted({r.item for r in found})
    at = {name: i for i, name in enumerate(names)}
    counts = np.zeros((len(names), LEVELS + 2))
    for r in found:
        counts[at[r.item], r.stratum] += r.n
    chosen = place(counts, np.array(list(shares.values())) / sum(shares.values())) if names else []
    labels = list(shares)
    placed = spark.createDataFrame([(n, labels[k]) for n, k in zip(names, chosen)], "item string, split string")
    return rows.join(items.join(F.broadcast(placed), "item").select("group_key", "split"), "group_key")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "splits")
    instructions = table(spark, sf_dir, "instructions")
    group = stage.put(groups(spark, instructions, table(spark, sf_dir, "sample_meta"), stage))
    level = instructions.groupBy("instruction_key").agg(F.min(level_of(F.col("difficulty_level"), F.col("instruction_id"))).alias("level"))
    return assign(stage.put(group.join(level, "instruction_key", "left")), stage)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct instruction with the smallest value tied to its group."""
    stage = Stage(spark, "groups")
    return groups(spark, table(spark, sf_dir, "instructions"), table(spark, sf_dir, "sample_meta"), stage)


def p2_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct instruction with its group and its split."""
    return _split(spark, sf_dir).select("instruction_key", "group_key", "split")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, groups and share of each level by split."""
    rows = _split(spark, sf_dir)
    by_level = rows.groupBy("split", "level").agg(F.count("*").alias("rows"), F.approx_count_distinct("group_key").alias("groups"))
    of_split = rows.groupBy("split").agg(F.count("*").alias("all_rows"))
    return by_level.join(of_split, "split").select("split", "level", "rows", "groups", (F.col("rows") / F.col("all_rows")).alias("share"))


def p2_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of any split: every distinct instruction has one place, and no group is in two splits."""
    rows = p2_split(spark, sf_dir)
    of_group = rows.groupBy("group_key").agg((F.min("split") != F.max("split")).alias("apart"), F.count("*").alias("n"), F.count("split").alias("placed"))
    return of_group.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("placed"), F.lit(0)).alias("placed"), F.count_if("apart").alias("groups_apart"))


QUERIES = {"p2_invariants": p2_invariants, "p2_found": p2_found, "p2_split": p2_split, "p2_report": p2_report}
#: Reachability over values and their minimum; quadratic in the largest group, so for small tables only.
SQL = {
    "p2_invariants": "SELECT count(DISTINCT instruction_key) AS rows, count(DISTINCT instruction_key) AS placed, 0::BIGINT AS groups_apart FROM instructions",
    "p2_found": r"""
WITH RECURSIVE i AS (
  SELECT DISTINCT instruction_key, lower(trim(domain, E' \t\n\r')) || '/' || lower(trim(sample_id, E' \t\n\r')) AS s, lower(trim(author, E' \t\n\r')) AS a FROM instructions),
m AS (
  SELECT DISTINCT lower(trim(domain, E' \t\n\r')) || '/' || lower(trim(sample_id, E' \t\n\r')) AS s, lower(trim(paper_id, E' \t\n\r')) AS v FROM sample_meta),
e AS (
  SELECT s AS u, a AS v FROM i WHERE a NOT IN ('', 'unknown', 'none', 'n/a', 'anonymous')
  UNION SELECT s, v FROM m WHERE v NOT IN ('', 'unknown', 'none', 'n/a', 'anonymous') AND s IN (SELECT s FROM i)),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r(x, y) AS (SELECT DISTINCT s, s FROM i UNION SELECT r.x, b.v FROM r JOIN b ON r.y = b.u)
SELECT instruction_key, min(y) AS group_key FROM i JOIN r ON r.x = i.s GROUP BY instruction_key"""
}
