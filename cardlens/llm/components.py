"""Connected components of a link table by min-label propagation with pointer
jumping; links and labels stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardlens.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links(a, b)``; the label is the
    smallest node reachable.

    Each round takes the smallest label among a node and its neighbours (an
    aggregate with map-side combine, so a node with very many links is one row
    per task) and then follows each label to that label's own label, so paths
    shrink geometrically.
    """
    both = stored(links.select("a", "b").unionByName(
        links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node"))
                    .agg(F.min("b").alias("m"))
                    .select("node", F.least("node", "m").alias("label")))
    while True:
        near = (both.join(labels.hint("shuffle_merge"), both["b"] == labels["node"])
                .groupBy("a").agg(F.min("label").alias("m")))
        step = stored(labels.join(near, labels["node"] == near["a"])
                      .select("node", F.least("label", "m").alias("label"),
                              (F.col("m") < F.col("label")).alias("moved")))
        if step.where("moved").isEmpty():
            return labels
        jump = step.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        labels = stored(step.join(jump.hint("shuffle_merge"), step["label"] == jump["_n"])
                        .select("node", F.least("label", "_l").alias("label")))
