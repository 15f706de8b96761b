"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.llm.shared import stage


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b): the smallest node reachable from it.

    Each round takes the smallest label among the neighbours and then the label of that label, so
    the rounds grow with the logarithm of the longest path. Rounds are written to the shared
    folder; nodes with very many neighbours are split by the adaptive skew join and combined
    before they are shuffled. Only counts reach the driver.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    edges = stage(both.distinct(), "edges")
    labels = stage(edges.groupBy("node").agg(F.min("other").alias("m")).select(
        "node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = (edges.join(labels.withColumnRenamed("node", "other"), "other")
                .groupBy("node").agg(F.min("label").alias("m")))
        pulled = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = stage(pulled.join(up, "label").select(
            "node", "old", F.least("label", "next").alias("label")), "labels")
        moved = new.where(F.col("label") != F.col("old")).limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels
