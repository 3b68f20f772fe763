"""Connected components of a graph too large for one machine, by repeated contraction.

In a round every node moves to the smallest label among itself and its neighbours, moves are followed once more, and the
edges are drawn between the new labels. Each component with an edge left loses at least its nodes that are no local
minimum, so the rounds grow with the logarithm of the longest chain. All steps are aggregates and joins.

Results: edges of a node with itself or with a null end are left out, repeated ones count once; a node without other edges has
no row; without edges the result is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import written


def labels(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) of every node of the edges a, b."""
    edges = written(edges.where("a <> b").select("a", "b"), "edges")
    found: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
        near = written(near.withColumn("label", F.least("node", "label")), "near")
        beyond = near.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        step = written(
            near.join(beyond, "label").select("node", F.col("beyond").alias("label")),
            "step",
        )
        if found is None:
            found = step
        else:
            moved = step.select(F.col("node").alias("label"), F.col("label").alias("moved"))
            found = written(
                found.join(moved, "label", "left").select("node", F.coalesce("moved", "label").alias("label")), "labels"
            )
        left = step.select(F.col("node").alias("a"), F.col("label").alias("la"))
        right = step.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        edges = written(
            edges.join(left, "a")
            .join(right, "b")
            .where("la <> lb")
            .select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
            .distinct(),
            "edges",
        )
    return found if found is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
