"""Connected components of an edge table, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), each of one type -> (node, label): label is the least node of node's component.

    Every round each node takes the least label among its own and its neighbours', then the label of
    that label. Rounds grow with the logarithm of the longest shortest path. Each round is written to the
    shared folder, so a lost executor costs one round at most.
    """
    both = materialise(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).where("u <> v").distinct())
    labels = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")))
    while True:
        seen = both.join(labels.select(F.col("u").alias("v"), F.col("l").alias("nl")), "v").groupBy("u").agg(F.min("nl").alias("nl"))
        nearer = labels.join(seen, "u", "left").select("u", F.col("l").alias("old"), F.least("l", F.coalesce("nl", "l")).alias("l"))
        jump = nearer.select(F.col("u").alias("x"), F.col("l").alias("xl"))
        new = materialise(nearer.join(jump, nearer["l"] == jump["x"], "left").select("u", "old", F.least("l", F.coalesce("xl", "l")).alias("l")))
        labels = new.select("u", "l")
        if new.where("old <> l").isEmpty():
            return labels.select(F.col("u").alias("node"), F.col("l").alias("label"))
