"""Similarity-graph tables: colors, edges, induced subgraphs and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfolio.session import cut

# Cluster colors in order, and that of no cluster.
PALETTE = ["#FF6B6B", "#4ECDC4", "#45B7D1", "#96CEB4", "#FFEAA7", "#DDA0DD", "#98D8C8", "#F7DC6F", "#BB8FCE", "#85C1E9", "#F8B500", "#00CED1"]
NO_COLOR = "#808080"


def cluster_colors(clusters: DataFrame) -> DataFrame:
    """``cluster_id, color``: its own color, or one of the palette by the order of ids.

    The order is over the cluster table, which has one row a cluster.
    """
    place = (F.row_number().over(W.orderBy("cluster_id")) - 1) % len(PALETTE)
    palette = F.array(*(F.lit(c) for c in PALETTE))
    return clusters.select("cluster_id", F.coalesce("color", F.get(palette, place)).alias("color"))


def undirected(edges: DataFrame) -> DataFrame:
    """One row for each unordered pair, with the largest weight."""
    pair = edges.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "weight")
    return pair.where("source < target").groupBy("source", "target").agg(F.max("weight").alias("weight"))


def indexed(edges: DataFrame) -> DataFrame:
    """Adds the dense ``edge_index`` by falling weight, then ends.

    Ranges of the order are numbered apart; only one count a range is summed up ahead
    of them, so no task holds all edges.
    """
    order = [F.desc("weight"), F.col("source"), F.col("target")]
    # Cut off here: both uses have to see the same ranges.
    ranged = cut(edges.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    inside = W.partitionBy("_range").orderBy(*order)
    numbered = ranged.withColumn("_n", F.row_number().over(inside))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    ahead = F.sum("_size").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    ahead = sizes.select("_range", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    return numbered.join(ahead, "_range").withColumn("edge_index", F.col("_n") + F.col("_ahead") - 1).drop("_range", "_n", "_ahead")


def edge_page(edges: DataFrame, cursor: int, limit: int) -> DataFrame:
    """Edges from an index on, with ``next_cursor`` (null at the end) in each row."""
    rows = edges.where(F.col("edge_index").between(cursor, cursor + limit))
    more = F.max("edge_index").over(W.partitionBy(F.lit(0))) >= cursor + limit
    rows = rows.withColumn("next_cursor", F.when(more, F.lit(cursor + limit).cast("long")))
    return rows.where(F.col("edge_index") < cursor + limit)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are both among the nodes."""
    ends = nodes.select("item_id").distinct()
    out = edges.join(ends.withColumnRenamed("item_id", "source"), "source", "left_semi")
    return out.join(ends.withColumnRenamed("item_id", "target"), "target", "left_semi")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that lack a node at one end at least."""
    # Cut off here: both sides of the join read them.
    edges = cut(edges)
    whole = induced(edges, nodes).select("source", "target")
    return edges.join(whole, ["source", "target"], "left_anti")


def visible_clusters(clusters: DataFrame, nodes: DataFrame) -> DataFrame:
    return clusters.join(nodes.select("cluster_id").distinct(), "cluster_id", "left_semi")


def top_starred(items: DataFrame, limit: int | None = None) -> DataFrame:
    """The most starred items, or all where no limit is set."""
    return items if limit is None else items.orderBy(F.desc("stars"), "item_id").limit(limit)
