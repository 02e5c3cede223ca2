"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.shared import stored


def connected(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for every id that edges (a, b) names."""
    both = stored(edges.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("other"))).where("id != other").distinct(), "edges")
    labels = stored(both.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        # the least label among the neighbours, then the label of one's label
        near = both.join(labels.select(F.col("id").alias("other"), F.col("component").alias("c")), "other").groupBy("id").agg(F.min("c").alias("c"))
        step = labels.join(near, "id").select("id", "component", F.least("component", "c").alias("c"))
        up = step.select(F.col("id").alias("c"), F.col("c").alias("cc"))
        new = step.join(up, "c", "left").select("id", F.coalesce("cc", "c").alias("component"), (F.coalesce("cc", "c") != F.col("component")).alias("moved"))
        new = stored(new, "labels")
        labels = new.select("id", "component")
        if new.where("moved").isEmpty():
            return labels
