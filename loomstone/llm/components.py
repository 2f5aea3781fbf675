"""Connected components of an edge table, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """edges(a, b) as written -> (node, label): each node of an edge and the least node it reaches.

    A round gives every node the least label around it and then that label's own label; each round is a written
    table. The number of rounds grows with the logarithm of a component's length.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        pulled = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        # what a node's label has heard, and the label's own label
        told = pulled.groupBy(F.col("was").alias("root")).agg(F.min("label").alias("told"))
        jumped = pulled.join(told.withColumnRenamed("root", "was"), "was").select("node", F.least("label", "told").alias("label"), "was")
        new = scratch.keep(jumped, "labels")
        own = scratch.keep(new.join(new.select(F.col("node").alias("label"), F.col("label").alias("up")), "label", "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label"), "was"), "labels")
        moved = own.filter(F.col("label") != F.col("was")).limit(1).count()
        scratch.drop(labels, new)
        labels = own
        if not moved:
            break
    else:
        raise RuntimeError("components did not settle")
    out = labels.select("node", "label")
    out._scratch_path = labels._scratch_path
    return out
