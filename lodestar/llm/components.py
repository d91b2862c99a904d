"""Connected components of a graph given as edges, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest node that edges reach.

    Each round takes the smallest label among the neighbours and then the label of that label, until nothing
    changes; the number of rounds grows with the logarithm of the longest path.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = scratch.keep(both, f"{name}_edges")
    labels = scratch.keep(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), f"{name}_labels0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("now"))
        jump = labels.select(F.col("node").alias("now"), F.col("label").alias("far"))
        # a label is a node, or nothing has a lower one
        found = lower.join(jump, "now", "left").select("node", "was", F.least("now", F.coalesce("far", "now")).alias("label"))
        found = scratch.keep(found, f"{name}_labels{step}")
        changed = found.filter("label <> was").limit(1).count()
        labels = found.select("node", "label")
        if step > 1:
            scratch.drop(f"{name}_labels{step - 1}")
        if not changed:
            return labels
