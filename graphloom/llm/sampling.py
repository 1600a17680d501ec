"""A sample that matches target shares of categories.

The categories form a tree: field of the domain, domain, difficulty level,
operation. The wanted size goes down the tree. At each node the children get
their target share, but no more than they have; what one cannot take goes to
its siblings first, in proportion to their shares. This makes the shares of
domains right, but a level or an operation that is short under one parent stays
short. So quota is then handed over between leaves, cousins included: each time
the move that brings the sums of all categories closest to what is wanted of
them, until no move helps. A category that is missing or has no target is a
branch of its own without share, so its rows can serve the categories they do
have; only rows without any are never drawn. The table of leaves depends on the categories alone,
never on the rows, and this is done on the driver.

``min_rows`` of each category, or all it has, are reserved before the rest is
shared out by target shares; where they exceed the sample size together, or
cannot be met together, the report says which are missed. At a leaf the rows are drawn by their rank in a permuted (hashed) order.
The rank comes from counts per hash range; only the range in which a leaf's
quota ends is sorted, so a leaf with a third of all rows is no hot task.
"""

from __future__ import annotations

import itertools
import re
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import folded
from ..session import table
from ..staging import Stage

DIMENSIONS = ("domain", "difficulty_level", "operation_type")
RANGES = 256
#: A row lacking from min_rows outweighs what it costs the shares of other categories.
BELOW_FLOOR = 1000.0
#: A row lacking from the target share outweighs one lacking from what is given beyond it in place of short categories.
BELOW_SHARE = 100.0


def level_of(level: Column, instruction_id: Column) -> Column:
    """The difficulty level; of a missing one the second part of the instruction id."""
    own = folded(level)
    return F.when(F.coalesce(own, F.lit("")).isin("", "unknown", "none"), F.lower(F.get(F.split(instruction_id, "_"), F.lit(1)))).otherwise(own)


def operation_of(operation: Column) -> Column:
    """The operation with blanks and hyphens as underscores; NULL if blank."""
    own = F.regexp_replace(folded(operation), r"(?U)[\s-]", "_")
    return F.when(own != "", own)


def categorised(instructions: DataFrame) -> DataFrame:
    """(key, domain, difficulty_level, operation_type) of every distinct instruction, compared forms.

    Rows with a NULL key are left out; of several rows of a key the smallest combination counts.
    """
    rows = instructions.select(
        F.col("instruction_key").alias("key"),
        folded(F.col("domain")).alias("domain"),
        level_of(F.col("difficulty_level"), F.col("instruction_id")).alias("difficulty_level"),
        operation_of(F.col("operation_type")).alias("operation_type"),
    ).where("key IS NOT NULL")
    return rows.groupBy("key").agg(F.min(F.struct(*DIMENSIONS)).alias("c")).select("key", "c.*")


def targets_of(sample_targets: DataFrame) -> DataFrame:
    """(dim_name, category, cat, target_share, min_rows); ``cat`` is the compared form. Missing numbers are 0."""
    return sample_targets.select(
        "dim_name", "category", F.when(F.col("dim_name") == "operation_type", operation_of(F.col("category"))).otherwise(folded(F.col("category"))).alias("cat"),
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("min_rows", F.lit(0)).alias("min_rows"),
    ).where("dim_name IS NOT NULL AND category IS NOT NULL").distinct()


def proportional(quota: float, weight: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Parts of ``quota`` in proportion to the weights, each within its bounds; parts without weight get more than ``low`` only of what the others cannot take.

    If the lower bounds alone are more than the quota, it is shared out in proportion to them.
    """
    quota = min(quota, float(high.sum()))
    if low.sum() >= quota:
        return low * (quota / low.sum() if low.sum() > 0 else 0.0)
    full = np.where(weight > 0, high, low).astype(float)
    if quota >= full.sum():
        room = high - full
        return full + room * ((quota - full.sum()) / room.sum() if room.sum() > 0 else 0.0)
    positive = weight > 0
    below, above = 0.0, float((high[positive] / weight[positive]).max())
    for _ in range(200):
        middle = (below + above) / 2
        below, above = (middle, above) if np.clip(middle * weight, low, high).sum() < quota else (below, middle)
    return np.clip(above * weight, low, high)


def whole_parts(parts: np.ndarray, total: int, high: np.ndarray) -> np.ndarray:
    """Whole numbers with the sum ``total`` by largest remainders, each at most its bound."""
    out = np.floor(parts + 1e-6).astype(np.int64)
    for i in np.lexsort((np.arange(len(parts)), -(parts - out).round(6))):
        if out.sum() >= total:
            break
        out[i] += out[i] < high[i]
    return out


def field_of(domain: str | None) -> str | None:
    """The field of a domain: domain_<field>_domain_<name>; NULL is a field of its own."""
    found = re.match(r"domain_(.+?)_domain_", domain or "", re.DOTALL)
    return found[1] if found else domain


def _top_down(paths: list[tuple], has: np.ndarray, quota: int, weights: list[dict], floors: list[dict], out: np.ndarray, index: np.ndarray, level: int = 0) -> None:
    """Share the quota of a node out to its children, rounded within the node; ``out`` gets the quotas of the leaves."""
    if level == len(weights):
        out[index] = quota
        return
    children: dict = {}
    for i in index:
        children.setdefault(paths[i][level], []).append(i)
    high = np.array([has[c].sum() for c in children.values()])
    weight = np.array([weights[level].get(c, 0.0) for c in children])
    low = np.minimum([floors[level].get(c, 0) for c in children], high)
    total = int(min(quota, high.sum()))
    for child, part in zip(children.values(), whole_parts(proportional(total, weight, low, high), total, high)):
        _top_down(paths, has, int(part), weights, floors, out, np.array(child), level + 1)


def hand_over(quota: np.ndarray, has: np.ndarray, codes: np.ndarray, wanted: list[np.ndarray], enough: list[np.ndarray], floors: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
    """Move quota between leaves until no move brings the sums of categories closer to what is wanted.

    ``codes`` has the category of each leaf by dimension. A category costs its
    squared distance over what is wanted, ``BELOW_SHARE`` times that of what it
    lacks of ``enough``, and ``BELOW_FLOOR`` times the square of what it lacks of
    its floor, where ``counts`` is 1; it costs nothing where that
    is 0. Of all pairs of leaves the best is
    taken: for each set of dimensions in which the two may agree, which then
    cost nothing, the cheapest giver and taker of each group of agreeing leaves.
    The cost falls with every move, so this ends.
    """
    quota, dims = quota.copy(), range(len(wanted))
    sums = [np.bincount(codes[d], quota, len(wanted[d])) for d in dims]

    def cost(d: int, at: np.ndarray, c: int | slice = slice(None)) -> np.ndarray:
        off = (at - wanted[d][c]) ** 2 + BELOW_SHARE * np.maximum(enough[d][c] - at, 0) ** 2
        return counts[d][c] * (off / np.maximum(wanted[d][c], 1.0) + BELOW_FLOOR * np.maximum(floors[d][c] - at, 0) ** 2)

    groups = []
    for agree in itertools.chain.from_iterable(itertools.combinations(dims, n) for n in range(len(wanted))):
        group = np.unique(codes[list(agree)], axis=1, return_inverse=True)[1].ravel() if agree else np.zeros(len(quota), int)
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0])
        groups.append(([d for d in dims if d not in agree], order, starts, np.r_[starts[1:], len(order)]))

    while len(quota):
        now = [cost(d, sums[d]) for d in dims]
        less = [(cost(d, sums[d] - 1) - now[d])[codes[d]] for d in dims]
        more = [(cost(d, sums[d] + 1) - now[d])[codes[d]] for d in dims]
        best = (-1e-7, 0, 0)
        for differ, order, starts, ends in groups:
            give = np.where(quota > 0, sum(less[d] for d in differ), np.inf)[order]
            take = np.where(quota < has, sum(more[d] for d in differ), np.inf)[order]
            change = np.minimum.reduceat(give, starts) + np.minimum.reduceat(take, starts)
            g = int(np.argmin(change))
            if change[g] < best[0]:
                part = slice(starts[g], ends[g])
                best = (float(change[g]), order[part][np.argmin(give[part])], order[part][np.argmin(take[part])])
        if best[0] == -1e-7:
            return quota
        a, b = best[1:]
        ends_of = [(d, codes[d][a], codes[d][b]) for d in dims if codes[d][a] != codes[d][b]]

        def moved(n: int) -> float:
            return sum(cost(d, sums[d][x] - n, x) + cost(d, sums[d][y] + n, y) for d, x, y in ends_of)

        low, high = 1, int(min(quota[a], has[b] - quota[b]))
        while low < high:  # the cost is convex in the number of rows moved
            middle = (low + high) // 2
            low, high = (middle + 1, high) if moved(middle + 1) < moved(middle) else (low, middle)
        quota[a] -= low
        quota[b] += low
        for d, x, y in ends_of:
            sums[d][x] -= low
            sums[d][y] += low
    return quota


def allocate(leaves: list[tuple], has: list[int], size: int, weights: dict[str, dict[str, float]], least: dict[str, dict[str, int]]) -> np.ndarray:
    """The quota of each leaf, given as its categories in the order of ``DIMENSIONS``.

    NULL is a category without share, which costs nothing by itself.
    """
    have, quota = np.array(has, dtype=np.int64), np.zeros(len(leaves), dtype=np.int64)
    if not leaves:
        return quota
    rows_of: dict[str, int] = {}
    for x, n in zip(leaves, has):
        rows_of[x[0]] = rows_of.get(x[0], 0) + n
    fields: dict[str, float] = {}
    field_floors: dict[str, int] = {}
    for domain, n in rows_of.items():
        own = max(weights["domain"].get(domain, 0.0), min(n, least["domain"].get(domain, 0)) / max(1, size))  # a field gets what its domains want
        fields[field_of(domain)] = fields.get(field_of(domain), 0.0) + own
        field_floors[field_of(domain)] = field_floors.get(field_of(domain), 0) + min(n, least["domain"].get(domain, 0))
    # A level or an operation owes its min_rows as a whole, not under each parent: hand_over sees to it.
    _top_down([(field_of(x[0]), *x) for x in leaves], have, size, [fields, *(weights[d] for d in DIMENSIONS)], [field_floors, least["domain"], {}, {}], quota, np.arange(len(leaves)))
    codes, wanted, enough, floors, counts = [], [], [], [], []
    for d, dim in enumerate(DIMENSIONS):
        names = sorted({x[d] for x in leaves}, key=lambda x: (x is not None, x or ""))
        at = {c: i for i, c in enumerate(names)}
        codes.append(np.array([at[x[d]] for x in leaves]))
        there = np.bincount(codes[d], have, len(names))
        share = np.array([weights[dim].get(c, 0.0) for c in names])
        named = np.array([c is not None for c in names], dtype=float)
        counts.append(named)
        floors.append(np.minimum([least[dim].get(c, 0) for c in names], there))
        # Domains have got theirs, with siblings of their field before others.
        wanted.append(np.bincount(codes[d], quota, len(names)) if dim == "domain" else proportional(float(quota.sum()), share, floors[-1], there * named))
        enough.append(np.minimum(np.minimum(share * size, there), wanted[-1]))
        floors[-1] = np.minimum(floors[-1], wanted[-1])  # less where all floors together exceed the size
    return hand_over(quota, have, np.array(codes), wanted, enough, floors, counts)


class Allocation:
    """Counts per leaf of the category tree, the sample size and the quota of each leaf.

    ``leaves`` has one row per combination of categories that occurs: its size
    depends on the categories alone, never on the rows.
    """

    def __init__(self, spark: SparkSession, instructions: DataFrame, sample_targets: DataFrame, share_of_rows: float = 0.2):
        self.stage = Stage(spark, "sampling")
        self.targets = self.stage.put(targets_of(sample_targets))
        rows = categorised(instructions)
        for d in DIMENSIONS:  # in leaf_*, values without a target become NULL
            cats = self.targets.where(F.col("dim_name") == d).select(F.col("cat").alias(f"leaf_{d}")).distinct()
            rows = rows.join(F.broadcast(cats), F.col(d) == F.col(f"leaf_{d}"), "left")
        self.rows = self.stage.put(rows)
        self.counts = self.stage.put(self.rows.groupBy(*[F.col(f"leaf_{d}").alias(d) for d in DIMENSIONS]).agg(F.count("*").alias("has")))
        self.total = self.counts.agg(F.sum("has")).first()[0] or 0
        self.size = int(self.total * share_of_rows + 1e-9)

    def quotas(self) -> DataFrame:
        """(domain, difficulty_level, operation_type, has, quota); quotas are whole and sum to the sample size, or to all there is.

        NULL stands for values missing or without a target.
        """
        leaves = sorted(self.counts.where(F.coalesce(*DIMENSIONS).isNotNull()).collect(), key=lambda r: [(x is not None, x or "") for x in r[: len(DIMENSIONS)]])
        targets = self.targets.groupBy("dim_name", "cat").agg(F.max("target_share").alias("weight"), F.max("min_rows").alias("least")).collect()
        weights, least = ({d: {r.cat: r[c] for r in targets if r.dim_name == d} for d in DIMENSIONS} for c in ("weight", "least"))
        quotas = allocate([r[: len(DIMENSIONS)] for r in leaves], [r.has for r in leaves], self.size, weights, least)
        schema = ", ".join(f"{d} string" for d in DIMENSIONS) + ", has bigint, quota bigint"
        return self.stage.spark.createDataFrame([(*r, int(q)) for r, q in zip(leaves, quotas)], schema)

    def draw(self, seed: int = 42) -> DataFrame:
        """The sampled rows: key and categories, also those without a target."""
        leaves = [f"leaf_{d}" for d in DIMENSIONS]
        quotas = self.quotas().where("quota > 0").select(*[F.col(d).alias(f"q_{d}") for d in DIMENSIONS], "quota")
        same = [F.col(f"leaf_{d}").eqNullSafe(F.col(f"q_{d}")) for d in DIMENSIONS]
        rows = self.rows.join(F.broadcast(quotas), reduce(and_, same)).drop(*[f"q_{d}" for d in DIMENSIONS])
        rows = rows.withColumn("h", F.xxhash64("key", F.lit(seed))).withColumn("range", F.shiftright(F.col("h"), 56).cast("int"))
        per = rows.groupBy(*leaves, "quota", "range").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*leaves).orderBy("range")) - F.col("n")
        per = self.stage.put(per.withColumn("before", upto).where("before < quota"))  # leaves x ranges, no more
        per = per.select(*[F.col(f"leaf_{d}").alias(f"q_{d}") for d in DIMENSIONS], F.col("range").alias("q_range"), "n", "before")
        kept = rows.join(F.broadcast(per), reduce(and_, same) & (F.col("range") == F.col("q_range")))
        whole = kept.where(F.col("before") + F.col("n") <= F.col("quota"))
        rank = F.dense_rank().over(Window.partitionBy(*leaves, "range").orderBy("h", "key"))
        edge = kept.where(F.col("before") + F.col("n") > F.col("quota")).withColumn("rank", rank).where(F.col("before") + F.col("rank") <= F.col("quota")).drop("rank")
        return whole.unionByName(edge).select("key", *DIMENSIONS)

    def report(self) -> DataFrame:
        """One row per target: what it asks for, what there is, what the allocation gives it, whether the category falls short,
        and whether the sample misses whole rows of it that are wanted (by share or ``min_rows``) and there.

        A category falls short if the leaves of the tree have fewer rows of it than ``min_rows`` or its share asks for; the allocation then hands
        its quota to siblings and cousins."""

        def per_dim(df: DataFrame) -> DataFrame:
            stack = F.explode(F.array(*[F.struct(F.lit(d).alias("dim_name"), F.col(d).alias("cat")) for d in DIMENSIONS])).alias("x")
            return df.select(stack, "has", "quota").select("x.*", "has", "quota").where("cat IS NOT NULL").groupBy("dim_name", "cat").agg(F.sum("has").alias("available"), F.sum("quota").alias("sampled"))

        out = self.targets.join(per_dim(self.quotas()), ["dim_name", "cat"], "left").fillna(0, ["available", "sampled"])
        asked = F.greatest(F.col("min_rows").cast("double"), F.col("target_share") * F.lit(float(self.size)))
        wanted = F.greatest(F.col("min_rows"), F.floor(F.col("target_share") * F.lit(float(self.size)) + 1e-9))
        return out.withColumn("falls_short", F.col("available") < asked).withColumn("missed", F.col("sampled") < F.least("available", wanted))


def _allocation(spark: SparkSession, sf_dir: str) -> Allocation:
    return Allocation(spark, table(spark, sf_dir, "instructions"), table(spark, sf_dir, "sample_targets"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets whose category has too few rows in the tree from which the sample is allocated."""
    return _allocation(spark, sf_dir).report().where("falls_short").select("dim_name", "category").distinct()


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample itself, a fifth of the distinct instructions."""
    return _allocation(spark, sf_dir).draw().select(F.col("key").alias("instruction_key"), *DIMENSIONS)


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and reached share of every target."""
    a = _allocation(spark, sf_dir)
    share = F.col("sampled") / F.lit(float(max(1, a.size)))
    return a.report().select("dim_name", "category", "target_share", "min_rows", "available", "sampled", share.alias("sampled_share"), "falls_short", "missed")


def p1_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of any sample: its size, and every row once."""
    rows = p1_sample(spark, sf_dir)
    return rows.groupBy().agg(F.count("*").alias("sampled"), F.count_distinct("instruction_key").alias("distinct_keys"))


QUERIES = {"p1_invariants": p1_invariants, "p1_found": p1_found, "p1_sample": p1_sample, "p1_report": p1_report}

_INSTRUCTIONS = r"""
WITH i AS (
  SELECT instruction_key,
         min(lower(trim(domain, E' \t\n\r'))) AS domain,
         min(CASE WHEN coalesce(lower(trim(difficulty_level, E' \t\n\r')), '') IN ('', 'unknown', 'none') THEN lower(split_part(instruction_id, '_', 2))
                  ELSE lower(trim(difficulty_level, E' \t\n\r')) END) AS level,
         min(nullif(regexp_replace(lower(trim(operation_type, E' \t\n\r')), '[\s-]', '_', 'g'), '')) AS operation
  FROM instructions GROUP BY instruction_key),
c AS (
  SELECT 'domain' AS dim_name, domain AS category, count(*) AS n FROM i GROUP BY domain
  UNION ALL SELECT 'difficulty_level', level, count(*) FROM i GROUP BY level
  UNION ALL SELECT 'operation_type', operation, count(*) FROM i WHERE operation IS NOT NULL GROUP BY operation)
"""
SQL = {
    "p1_invariants": "SELECT count(DISTINCT instruction_key) // 5 AS sampled, count(DISTINCT instruction_key) // 5 AS distinct_keys FROM instructions",
    "p1_found": _INSTRUCTIONS + """
SELECT DISTINCT t.dim_name, t.category FROM sample_targets t LEFT JOIN c ON c.dim_name = t.dim_name AND c.category = lower(trim(t.category))
WHERE coalesce(c.n, 0) < t.min_rows OR coalesce(c.n, 0) < t.target_share * ((SELECT count(*) FROM i) // 5)"""
}
