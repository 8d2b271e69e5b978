"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardscope.session import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable, by alternating large-star and small-star steps.

    Nodes may be of any type that can be ordered; a node without an edge to another one is
    not returned.  Each step writes its edges once, and steps grow with the logarithm of the
    longest chain.  Neighbourhoods are reduced to their minimum before they are shuffled, so
    a node with very many edges is no single task's work.
    """
    edges = cut_lineage(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u < v").distinct())
    state = None
    while True:
        # large star: the larger neighbours of each node go to the smallest of its neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = edges.join(least, "u").select(F.col("m").alias("u"), "v").filter("u < v").distinct()
        # small star: the smaller neighbours of each node, and the node, go to the smallest
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("m").alias("u"), F.col("u").alias("v")).unionByName(low.select(F.col("m").alias("u"), "v"))
        edges = cut_lineage(small.filter("u < v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        state = now
