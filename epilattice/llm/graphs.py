"""Connected components of links as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epilattice.session import settle


def components(links: DataFrame) -> DataFrame:
    """``node, label``: every node of ``links`` (columns ``a, b``) with the smallest node that it is connected to.

    Each step gives a node the smallest label around it and then that label's own label of the step before, so distances
    shrink by a factor. A hub's links are an aggregate with map-side combine on one side and may be split by Spark on the
    other. Each step is stored, so both lookups read one stored table; the steps end when no label changes.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = settle(both.filter("a <> b"), "links")
    labels = settle(edges.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("label")), "labels")
    while True:
        around = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(around.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("further"))
        stepped = settle(nearer.join(jump, "new", "left").select("node", F.least("new", F.coalesce("further", "new")).alias("label"), "old"), "labels")
        labels = stepped.select("node", "label")
        if not stepped.filter("label <> old").take(1):
            return labels
