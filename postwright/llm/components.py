"""Connected components by repeated contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwright.llm.common import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` -> ``(node, component)``: the least node that each node reaches.

    Each round points every node at its least neighbour, contracts the edges and
    drops those that fall together, so the graph shrinks geometrically for node
    names without order (hashes). Nothing is gathered on the driver: only
    whether edges are left. A hub's minimum is partially aggregated; its joins are
    on an exchange that adaptive execution can split.
    """
    labels, current = None, edges.select("u", "v").filter("u <> v").distinct()
    while True:
        current = stage(current, "cc-edges")
        if current.isEmpty():
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("parent"))
        step = stage(step, "cc-step")
        if labels is None:
            labels = step.select(F.col("u").alias("node"), F.col("parent").alias("component"))
        else:
            labels = labels.join(step, labels.component == step.u, "left").select(
                "node", F.coalesce("parent", "component").alias("component")
            )
            labels = stage(labels, "cc-labels")
        to_u = step.select(F.col("u"), F.col("parent").alias("pu"))
        to_v = step.select(F.col("u").alias("v"), F.col("parent").alias("pv"))
        current = current.join(to_u, "u").join(to_v, "v").filter("pu <> pv")
        current = current.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).limit(0)
    return labels
