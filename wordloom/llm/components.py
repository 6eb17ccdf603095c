"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of the links; label is the smallest node of its component.

    Each round gives a node the smallest label among its neighbours' and its own, then
    replaces labels by their labels' labels, so paths halve. Counts of neighbours go
    through partial aggregates, so that a hub with very many links is no single task's work.
    Rounds end when no label changes. Null ends count as no link.
    """
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    ways = F.inline(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))
    both = kept(ends.select(ways).distinct(), "links")
    labels = kept(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("x"), F.min("y")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("label").alias("least"))
        step = labels.join(near, labels.node == near.x, "left").select("node", "label", F.least("label", "least").alias("new"))
        step = kept(step, "step")
        heads = step.select(F.col("node").alias("top"), F.col("new").alias("jump"))
        jumped = step.join(heads, step.new == heads.top, "left").select(
            "node", F.col("label").alias("old"), F.least("new", "jump").alias("label")
        )
        jumped = kept(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.where("old <> label").isEmpty():
            return labels
