"""Connected components of an undirected edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.text import shared_table


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of (a, b) rows of longs: the label is the smallest node that it is linked with.

    Each round gives a node the smallest label around it and then that label's own label, so a chain is halved and a star
    takes two rounds. Nothing is gathered by node but a minimum, so a node with very many links is no burden.
    """

    both = shared_table(edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a")).distinct(), "edges")
    labels = shared_table(both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("near"), F.col("label").alias("seen")), "near").groupBy("node").agg(F.min("seen").alias("seen"))
        closer = labels.join(around, "node").select("node", F.least("label", "seen").alias("next"), "label")
        heads = labels.select(F.col("node").alias("next"), F.col("label").alias("head"))
        moved = shared_table(closer.join(heads, "next").select("node", F.least("next", "head").alias("label"), (F.least("next", "head") < F.col("label")).alias("moved")), "labels")
        labels = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return labels
