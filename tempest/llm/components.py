"""Connected components of an edge table, by contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempest.session import materialise


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(id, label) of every node of ``edges`` (long columns a, b); label: one node of its component.

    Each round gives a node the smallest id among itself and its neighbours and replaces the edges
    by edges between these, until none is left; rounds fall off geometrically as ids are unrelated
    to the graph.  A node with very many neighbours is a row per task after the partial minimum, and
    its side of a join is one that Spark can split, as both sides are read from written tables.
    """
    edges = materialise(edges.where("a <> b").select("a", "b").distinct(), folder, "edges-0")
    labels, k = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label"))
        least = materialise(least, folder, f"least-{k}")
        if labels is None:
            labels = least
        else:
            step = least.select(F.col("id").alias("s_id"), F.col("label").alias("s_label"))
            labels = labels.join(step, F.col("label") == F.col("s_id"), "left").select("id", F.coalesce("s_label", "label").alias("label"))
            labels = materialise(labels, folder, f"labels-{k}")
        k += 1
        left = least.select(F.col("id").alias("a"), F.col("label").alias("la"))
        right = least.select(F.col("id").alias("b"), F.col("label").alias("lb"))
        edges = (edges.join(left, "a").join(right, "b").where("la <> lb")
                 .select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
        edges = materialise(edges, folder, f"edges-{k}")
        if edges.isEmpty():
            return labels
