"""Connected components over an edge table, without gathering any component in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` -> ``(node, label)``; label is the smallest node that is reachable.

    Each round takes the minimum over the neighbours (a map-side combined aggregate) and then
    jumps to the label's own label, so long chains close in about log(length) rounds. Every
    round is a written table; joins on a hub node are skew joins that Spark can split.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = scratch.table(both.where("u <> v").distinct())
    labels = scratch.table(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = scratch.table(step.join(jump, "label").select("node", "was", F.least("label", "far").alias("label")))
        done = moved.where("label <> was").limit(1).count() == 0
        scratch.drop(labels)
        labels = moved
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    scratch.drop(both)
    return labels.select("node", "label")
