"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of edges (a, b), both longs.

    Each round every node takes the smallest label among its neighbours' and
    then its label's label. Labels are written to the scratch folder each
    round; the driver sees one count.  Null ends are not edges.
    """
    clean = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = materialize(clean.union(clean.select("b", "a")).distinct())
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        of_label = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped = lower.join(of_label, "component", "left").select("node", "was", F.least("component", "next").alias("component"))
        step = materialize(jumped)
        labels = step.select("node", "component")
        if not step.where("was <> component").limit(1).count():
            return labels
