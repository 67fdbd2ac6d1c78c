"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b): the smallest node that is reachable.

    Each round takes the least label among the neighbours, then the label's own
    label, so long chains shrink as a power of two. Labels only fall, so the sum
    tells when nothing changed. Rounds are cut by checkpoints.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    both = cut(both.filter("u <> v").distinct())
    labels = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("label")).select(F.col("u").alias("node"), "label"))
    total = None
    while True:
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)")), F.count("*")).first()
        if now == total:
            return labels
        total = now
        least = both.join(labels, both["u"] == labels["node"]).groupBy("v").agg(F.min("label").alias("_l"))
        lower = labels.join(least, labels["node"] == least["v"]).select("node", F.least("label", "_l").alias("label"))
        jump = lower.select(F.col("node").alias("_n"), F.col("label").alias("_to"))
        labels = cut(lower.join(jump, F.col("label") == F.col("_n")).select("node", F.col("_to").alias("label")))
