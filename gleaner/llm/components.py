"""Connected components by minimum labels with shortcuts, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import delete, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over edges (a, b), for every node of an edge.

    Each round takes the smallest label among a node and its neighbours, then the label of that label, so that long chains halve.
    Labels are written to the shared folder each round; nothing is collected but the number of changed labels.
    """
    both, at = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels, last = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        step, mid = written(step, "step")
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("far"))
        new, path = written(step.join(jump, "to", "left").select("node", F.least("to", F.coalesce("far", "to")).alias("label"), "was"), "labels")
        changed = new.where("label <> was").limit(1).count()
        delete(labels.sparkSession, last)
        delete(labels.sparkSession, mid)
        labels, last = new.select("node", "label"), path
        if not changed:
            delete(labels.sparkSession, at)
            return labels
