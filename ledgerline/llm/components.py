"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for the ids of edges (a, b): component is the smallest id reachable.

    Each round takes the smallest label around every id and then that label's own label, so paths halve; only the number
    of labels that changed comes to the driver. Labels go to the shared folder after each round.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("near"))
        least = labels.join(near, F.col("id") == F.col("a")).select("id", F.col("component").alias("old"), F.least("component", "near").alias("to"))
        root = labels.select(F.col("id").alias("to"), F.col("component").alias("root"))
        fresh = written(least.join(root, "to").select("id", F.least("to", "root").alias("component"), "old"), "labels")
        changed = fresh.filter("component <> old").limit(1).count()
        dropped(labels)
        labels = fresh.select("id", "component")
        if not changed:
            return labels
