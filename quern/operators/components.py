"""Connected components of an edge table, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.runtime import drop, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for edges (a, b): component is the least node that can be reached; nodes without edges are absent.

    Each round takes the least label among a node's neighbours, then the label of that label, so that long paths
    shrink fast (a path of n nodes takes about log2 n rounds; `most_rounds` is a guard that raises). Rounds are written to
    shared storage, so a lost executor costs one round.
    """
    both = edges.where("a <> b").select("a", "b")
    both = written(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        new = written(new.join(jump, "to").select("node", "old", F.least("to", "further").alias("label")), "labels")
        drop(labels)
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            break
    else:
        raise RuntimeError(f"labels still changed after {most_rounds} rounds")
    drop(both)
    return labels.select("node", F.col("label").alias("component"))
