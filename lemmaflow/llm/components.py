"""Connected components of an edge table, by spreading the least label and halving paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b). Returns (node, label) for each node of an edge; label is the least
    node it is connected with. Every round takes the least label among the neighbours
    and then the label's own label; each round's table is written to the shared folder."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stash(both.where("a <> b").distinct(), "cc-edges")
    labels = stash(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "cc-start")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = stash(labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "cc-step")
        above = step.select(F.col("node").alias("up"), F.col("label").alias("top"))
        done = stash(step.join(above, step["label"] == above["up"]).select("node", "old", "top"), "cc-jump")
        changed = done.where("top <> old").limit(1).count()
        labels = done.select("node", F.col("top").alias("label"))
        if not changed:
            return labels
