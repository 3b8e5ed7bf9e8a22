"""Connected components of a link table, by minimum labels and pointer jumping; nothing reaches the driver but sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (u, v); a component is its smallest node."""
    edges = edges.select("u", "v").where(F.col("u") != F.col("v"))
    both = materialize(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("component")).withColumnRenamed("u", "node"))
    total = lambda x: x.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
    before = total(labels)
    while before is not None:
        seen = both.join(labels, both["v"] == labels["node"]).select(F.col("u").alias("node"), "component")
        lower = materialize(seen.unionByName(labels).groupBy("node").agg(F.min("component").alias("component")))
        up = lower.select(F.col("node").alias("component"), F.col("component").alias("higher"))
        labels = materialize(lower.join(up, "component", "left").select("node", F.least("component", F.coalesce("higher", "component")).alias("component")))
        after = total(labels)
        if after == before:
            break
        before = after
    return labels
