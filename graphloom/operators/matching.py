"""Joins of special shape (J7, J11-J16): division, containment, best match, assignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metrics import assignment, greedy_matches, iou, matching_cost
from ..functions.scoring import looks_like_element


def having_all(df: DataFrame, keys: list[str], value: str, wanted: list[str]) -> DataFrame:
    """Keys that have every wanted value."""
    return df.where(F.col(value).isin(wanted)).groupBy(*keys).agg(F.countDistinct(value).alias("_n")).where(F.col("_n") == len(set(wanted))).drop("_n")


def comparable_name(c):
    """Letters and digits only, lower-cased."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def contained_names(left: DataFrame, right: DataFrame, shortest: int = 4) -> DataFrame:
    """(name_l, name_r): the comparable form of one contains that of the other; names below ``shortest`` match if equal.

    Containment is no equality, but a name that lies in another shares all its
    runs of ``shortest`` characters with it. The join is on one such run: the
    smallest of the shorter name, against all runs of the longer.
    """
    l, r = (df.select(F.col(df.columns[0]).alias(f"name_{s}")).distinct().withColumn(f"c_{s}", comparable_name(F.col(f"name_{s}"))).where(f"c_{s} != ''") for df, s in ((left, "l"), (right, "r")))

    def runs(df: DataFrame, s: str) -> DataFrame:
        count = F.greatest(F.lit(1), F.length(f"c_{s}") - (shortest - 1))
        return df.withColumn("runs", F.array_distinct(F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(f"c_{s}", i, F.lit(shortest)))))

    lr, rr = runs(l, "l"), runs(r, "r")
    a = lr.withColumn("run", F.array_min("runs")).drop("runs").join(rr.withColumn("run", F.explode("runs")).drop("runs"), "run").where(F.contains("c_r", "c_l"))
    b = rr.withColumn("run", F.array_min("runs")).drop("runs").join(lr.withColumn("run", F.explode("runs")).drop("runs"), "run").where(F.contains("c_l", "c_r"))
    cols = ["name_l", "name_r", "c_l", "c_r"]
    return a.select(cols).union(b.select(cols)).distinct()


def best_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each left name the best contained right name: exact, then as a suffix, then the first by name."""
    pairs = contained_names(left, right)
    exact, suffix = F.col("c_l") == F.col("c_r"), F.col("c_r").endswith(F.col("c_l")) | F.col("c_l").endswith(F.col("c_r"))
    rank = F.row_number().over(Window.partitionBy("name_l").orderBy(exact.desc(), suffix.desc(), "name_r"))
    return pairs.withColumn("_n", rank).where("_n = 1").select("name_l", "name_r")


def _solve(left: np.ndarray, right: np.ndarray, costs: np.ndarray, below: float) -> list[tuple[int, int, float]]:
    rows, i = np.unique(left, return_inverse=True)
    columns, j = np.unique(right, return_inverse=True)
    table = np.full((len(rows), len(columns)), np.inf)
    np.minimum.at(table, (i, j), costs)
    try:
        pairs = assignment(table)
    except ValueError:
        return []
    return [(int(rows[a]), int(columns[b]), float(table[a, b])) for a, b in pairs if table[a, b] < below]


def optimal_pairs(costs: DataFrame, group: str, below: float = 0.5) -> DataFrame:
    """costs (group, left_id, right_id, cost) to the pairs of a cheapest assignment per group with cost below the bound.

    A group whose only assignments are infinite gives no rows. A group is one
    record with few boxes, so its costs fit a row; NULL costs count as infinite.
    """
    found = T.ArrayType(T.StructType([T.StructField("left_id", T.LongType()), T.StructField("right_id", T.LongType()), T.StructField("cost", T.DoubleType())]))

    @F.pandas_udf(found)
    def solve(left: pd.Series, right: pd.Series, cost: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("left_id", "right_id", "cost"), p)) for p in _solve(np.asarray(a), np.asarray(b), np.asarray(c, float), below)] for a, b, c in zip(left, right, cost)])

    listed = costs.groupBy(group).agg(F.collect_list(F.struct("left_id", "right_id", F.coalesce("cost", F.lit(float("inf"))).alias("cost"))).alias("l"))
    return listed.select(group, solve("l.left_id", "l.right_id", "l.cost").alias("p")).select(group, F.inline("p"))


def greedy_pairs(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, matched, of): how many left texts of a row find a right one, first fit in order. Arrays of a row only."""

    @F.pandas_udf(T.IntegerType())
    def matched(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([len(greedy_matches([x for x in p if x is not None], [x for x in q if x is not None])) if p is not None and q is not None else 0 for p, q in zip(a, b)])

    return df.select(key, matched(left, right).alias("matched"), F.greatest(F.size(left), F.lit(0)).alias("of"))


def element_recall(df: DataFrame, key: str, original: str, rendered: str) -> DataFrame:
    """M8: (key, matched, of, score, success): the part of the element lines of one text that the other text has.

    A text without element lines has a recall of 0. A missing original fails with 0, a missing rendered text with NULL.
    """
    lines = [F.filter(F.split(c, "\n"), looks_like_element).alias(a) for c, a in ((original, "_a"), (rendered, "_b"))]
    given = [F.col(c).isNotNull() for c in (original, rendered)]
    rows = df.select(F.struct(F.col(key).alias("k"), given[0].alias("o"), given[1].alias("r")).alias("_key"), *lines)
    found = greedy_pairs(rows, "_key", "_a", "_b")
    recall = F.when(F.col("of") > 0, F.col("matched") / F.col("of")).otherwise(0.0)
    score = F.when(~F.col("_key.o"), 0.0).when(F.col("_key.r"), recall)
    return found.select(F.col("_key.k").alias(key), "matched", "of", score.alias("score"), (F.col("_key.o") & F.col("_key.r")).alias("success"))


def structural_fidelity(reference: DataFrame, generated: DataFrame, group: str, below: float = 0.5) -> DataFrame:
    """(group, matched, score, success): mean IoU over the optimally matched boxes (group, id, kind, x, y, w, h) of two sides.

    No pair below the bound is a score of 0. A group with boxes on one side only
    fails with 0; one whose only assignments are infinite fails with NULL.
    """
    sides = [df.select(group, F.col("id").alias(f"{side}_id"), *[F.col(c).alias(f"{c}_{side}") for c in ("kind", *"xywh")]) for df, side in ((reference, "left"), (generated, "right"))]
    one, two = ({c: F.col(f"{c}_{side}") for c in "xywh"} for side in ("left", "right"))
    cost = matching_cost(F.col("kind_left"), F.col("kind_right"), one, two)
    both = sides[0].join(sides[1], group).select(group, "left_id", "right_id", cost.alias("cost"), iou(one, two).alias("iou"))
    # Every pair of the assignment, to tell one without a near pair from none at all.
    pairs = optimal_pairs(both.drop("iou"), group, float("inf")).withColumnRenamed("cost", "_cost")
    near = F.col("_cost") < below
    means = pairs.join(both, [group, "left_id", "right_id"]).groupBy(group).agg(F.count_if(near).alias("matched"), F.coalesce(F.avg(F.when(near, F.col("iou"))), F.lit(0.0)).alias("mean"))
    groups = reference.select(group, F.lit(1).alias("l"), F.lit(0).alias("r")).union(generated.select(group, F.lit(0).alias("l"), F.lit(1).alias("r")))
    groups = groups.groupBy(group).agg((F.max("l") + F.max("r") == 2).alias("full"))
    out = groups.join(means, group, "left")
    return out.select(group, F.coalesce("matched", F.lit(0)).alias("matched"), F.when(F.col("full"), F.col("mean")).otherwise(0.0).alias("score"), (F.col("full") & F.col("mean").isNotNull()).alias("success"))
