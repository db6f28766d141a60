"""Connected components of a graph given as edges, by joins and aggregates alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_scope


def components(edges: DataFrame) -> DataFrame:
    """(node, label, old): the smallest node that each node reaches; edges: (a, b), in one direction at least.

    Each round a node takes the smallest label among its own, its neighbours' and its label's label, so
    labels cross long chains in few rounds. Every round is written to the shared folder. A label with very
    many nodes is the skewed side of a join whose other side has one row for it, which Spark can split.
    """
    with scratch_scope(edges.sparkSession) as keep:
        return keep(rounds(edges))


def rounds(edges: DataFrame) -> DataFrame:
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).withColumn("label", F.least("node", "label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = materialize(step, "step")
        up = step.select(F.col("node").alias("_node"), F.col("label").alias("_up"))
        labels = materialize(step.join(up, F.col("label") == F.col("_node")).select("node", "old", F.least("label", "_up").alias("label")), "labels")
        if labels.where("old <> label").limit(1).count() == 0:
            return labels
        labels = labels.drop("old")
