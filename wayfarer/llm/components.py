"""Connected components of an edge table, by smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm._shared import bucketed


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) for every node of ``edges`` (a, b: longs).

    Each round a node takes the smallest label among its own, its neighbours',
    and the label of its label; rounds end when no label falls.  The jump over
    labels makes long chains take a logarithmic number of rounds.  Each round
    is written to the shared folder; edges and labels are in buckets, so the edges
    are not shuffled again and a round has three shuffles.
    """
    both = bucketed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct().repartition("b"), "edges", "b")
    labels = bucketed(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels0", "node")
    step = 0
    while True:
        step += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        now = labels.join(near.withColumnRenamed("a", "node"), "node", "left").join(jump, "label", "left")
        now = now.select("node", F.col("label").alias("was"), F.least("label", "near", "jump").alias("label"))
        now = bucketed(now.repartition("node"), f"labels{step}", "node")
        if now.where("label < was").isEmpty():
            return now.select("node", F.col("label").alias("component"))
        labels = now.select("node", "label")
