"""Connected components of a bipartite record-value graph by minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import Stage

#: A key with more than this share of the rows is joined by broadcast; at most 1 / HOT_SHARE keys are.
HOT_SHARE = 1e-3


def _hot(rows: DataFrame, key: str, least: float) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > least).select(key)


def _met(rows: DataFrame, labels: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """rows with the label of their key (if it has one); the rows of hot keys stay where they are and get the labels of these few keys by broadcast."""
    few = F.broadcast(hot.withColumn("is_hot", F.lit(True)))  # at most 1 / HOT_SHARE rows
    marked = rows.join(few, key, "left")
    cold = marked.where("is_hot IS NULL").drop("is_hot").join(labels, key)
    warm = marked.where("is_hot").drop("is_hot").join(F.broadcast(labels.join(F.broadcast(hot), key, "left_semi")), key)
    return cold.unionByName(warm)


def components(incidence: DataFrame, stage: Stage, record: str = "rec", value: str = "val", max_rounds: int = 60) -> DataFrame:
    """(val, label): every value with the smallest value of its component.

    One round passes the smallest label of a record's values to the record, the
    smallest of a value's records back to the value, and then lets every label
    jump to the label of the value it names, which halves the longest way left.
    All three are map-side combined minima after a join; the rows of a value, a
    record or a label that holds more than a thousandth of all rows are not
    shuffled for the join. Rounds are cut by a staged table; they end when a
    round changes no label. Records without values play no part.
    """
    links = stage.put(incidence.select(F.col(record).alias("rec"), F.col(value).alias("val")).where("rec IS NOT NULL AND val IS NOT NULL").distinct())
    least = max(100.0, links.count() * HOT_SHARE)
    hot_values, hot_records = stage.put(_hot(links, "val", least)), stage.put(_hot(links, "rec", least))
    own = links.groupBy("rec").agg(F.min("val").alias("label"))
    labels = stage.put(_met(links, own, "rec", hot_records).groupBy("val").agg(F.min("label").alias("label")))
    before = None
    for _ in range(max_rounds):
        mark = labels.agg(F.bit_xor(F.xxhash64("val", "label")), F.count("*")).first()
        if tuple(mark) == before:
            break
        before = tuple(mark)
        to_record = _met(links, labels, "val", hot_values).groupBy("rec").agg(F.min("label").alias("label"))
        nearer = stage.put(_met(links, to_record, "rec", hot_records).groupBy("val").agg(F.min("label").alias("label")))
        named = nearer.select(F.col("val").alias("label"), F.col("label").alias("further"))
        jumped = stage.put(_met(nearer, named, "label", _hot(nearer, "label", least)).select("val", F.least("label", "further").alias("label")))
        stage.drop(nearer)
        stage.drop(labels)
        labels = jumped
    else:
        raise RuntimeError(f"labels still change after {max_rounds} rounds")
    return labels
