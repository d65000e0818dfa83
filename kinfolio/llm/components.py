"""Connected components of an edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfolio.session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, comp``: the smallest node that each node of an edge is connected with.

    Loops and repeated edges are allowed; an empty edge list gives an empty result. No
    step gathers a node's neighbours: minima are aggregated and joined back.
    """
    start = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    now, before = cut(start), None
    while True:
        # Large star: each larger neighbour moves to the smallest of the neighbourhood.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: smaller neighbours, and the node itself, move to the smallest of them.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = cut(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if state == before:
            break
        before = state
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return nodes.unionByName(nodes.select(F.col("comp").alias("node"), "comp")).distinct()
