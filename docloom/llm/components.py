"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) of every node that has an edge (columns a, b: long).

    Each round is a grouped minimum and a join on the node; rounds are written to the shared folder, so
    the plan doesn't grow. Both rounds keep the components and end when every node points at its
    smallest. Self-edges are ignored.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large.where("u <> v"), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "small-star")
        same = small.exceptAll(now).isEmpty() and now.exceptAll(small).isEmpty()
        discard(now, large)
        now = small
        if same:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v").distinct())
