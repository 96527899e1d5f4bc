"""Connected components by least labels and pointer jumping; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.common import store


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of edges (a, b): label is the least node of the component."""
    both = store(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("least"))
        new = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        new = store(new, "labels")
        up = new.select(F.col("node").alias("over"), F.col("label").alias("top"))
        jumped = store(new.join(up, new.label == up.over, "left").select("node", "old", F.least("label", F.coalesce("top", "label")).alias("label")), "labels")
        labels = jumped.select("node", "label")
        if jumped.where("old <> label").isEmpty():
            return labels
