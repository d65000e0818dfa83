"""Whole jobs composed of the other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfolio.functions.numbers import node_size
from kinfolio.functions.text import embedding_text, fallback_tags, parse_enrichment_reply, readme_signal
from kinfolio.operators.browse import join_lists, pending
from kinfolio.operators.embed import embed_hashing
from kinfolio.operators.graph import NO_COLOR, cluster_colors
from kinfolio.operators.lists import ListIndex
from kinfolio.operators.pairs import related_items, similarity_edges
from kinfolio.operators.report import monthly_timeline
from kinfolio.session import cut


def enrich_and_embed(items: DataFrame, replies: DataFrame, dimensions: int) -> DataFrame:
    """Items without a vector get summary and tags from reply rows (item_id, reply), and a vector of their text."""
    todo = pending(items).drop("embedding").join(replies, "item_id", "left").withColumn("_p", parse_enrichment_reply(F.col("reply")))
    summary = F.coalesce("summary", F.nullif(F.col("_p.summary"), F.lit("")), "description")
    tags = F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.col("_p.tags"))
    done = todo.withColumns({"summary": summary, "tags": fallback_tags(tags, F.col("topics"), F.col("language"), F.col("full_name"))})
    text = embedding_text(F.col("full_name"), F.col("description"), F.col("topics"), F.col("language"), F.col("summary"), F.col("tags"), readme_signal(F.col("readme")))
    done = done.withColumn("_text", text)
    vectors = embed_hashing(done, "item_id", "_text", dimensions)
    return done.drop("_p", "reply", "_text", "needs_enrichment").join(vectors, "item_id")


def build_snapshot(items: DataFrame, clusters: DataFrame, lists: DataFrame, k: int = 8, threshold: float = 0.5, candidates: str | ListIndex = "exact") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes of embedded and placed items, edges, monthly timeline, and one row with the version's name."""
    placed = items.where("embedding is not null and x is not null")
    nodes = join_lists(placed.join(cluster_colors(clusters), "cluster_id", "left"), lists)
    nodes = nodes.withColumns({"size": node_size(F.col("stars")), "color": F.coalesce("color", F.lit(NO_COLOR))})
    edges = cut(similarity_edges(items, threshold, k, candidates))  # counted for the name and returned
    totals = nodes.agg(F.count("*").alias("n")).join(edges.agg(F.count("*").alias("e")))
    version = totals.select(F.format_string("snapshot-%s-n%d-e%d", F.date_format(F.current_timestamp(), "yyyyMMddHHmmss"), "n", "e").alias("version"))
    return nodes, edges, monthly_timeline(items), version


def materialize_related(items: DataFrame, limit: int, min_score: float, min_semantic: float, candidates: str | ListIndex = "exact", nearest: int | None = None) -> DataFrame:
    """``item_id, related`` (ids, best first) of every anchor with related items, out of its ``nearest``."""
    found = related_items(items, limit, min_score, min_semantic, candidates, nearest=nearest)
    listed = F.sort_array(F.collect_list(F.struct("rank", "target")))
    return found.groupBy(F.col("source").alias("item_id")).agg(F.transform(listed, lambda x: x["target"]).alias("related"))


def previous_versions(rows: DataFrame, owner: str, version: str) -> DataFrame:
    """For each owner the version activated last before the newest."""
    last = W.partitionBy(owner).orderBy(F.col("activated_at").desc_nulls_last(), F.desc(version))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 2").select(owner, version)
