"""Queries over relevance, related items and the similarity graph."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kinfolio.functions import relevance as rel
from kinfolio.functions.tags import normalize_tags, tag_overlap, tag_union
from kinfolio.operators import graph as G
from kinfolio.operators import pairs as P
from kinfolio.operators.lists import ListIndex, build
from kinfolio.plans.base import CLUSTERS, clusters, items, query, with_items
from kinfolio.session import shared_dir

# Parameters of the generated vectors, whose cosines are low.
MIN_SEMANTIC, MIN_SCORE, THRESHOLD, DEGREE = 0.2, 0.25, 0.25, 8


def _sql_tag(x: str) -> str:
    base = f"regexp_replace(replace(lower(trim({x})), '_', '-'), '[^a-z0-9\\-\\x{{4e00}}-\\x{{9fff}}]+', '-', 'g')"
    return f"trim(regexp_replace({base}, '-+', '-', 'g'), '-')"


def sql_tags(arr: str) -> str:
    """Normalised tags in SQL; none of the generated tags has a synonym."""
    pieces = f"flatten(list_transform({arr}, lambda t: CASE WHEN regexp_matches(t, '[,/|;，、 ]') THEN string_split_regex(trim(t), '[,\\s/|;，、]+') ELSE [t] END))"
    named = f"list_filter(list_transform({pieces}, lambda t: {_sql_tag('t')}), lambda t: t <> '')"
    # distinct in order of first appearance
    return f"list_filter({named}, lambda t, i: list_position({named}, t) = i)"


NORMED = f"normed AS (SELECT *, {sql_tags('list_concat(tags, topics)')} AS nt, CAST(embedding AS DOUBLE[]) AS v FROM items)"
_INTER = "len(list_intersect(a.nt, b.nt))"
_UNION = "(len(a.nt) + len(b.nt) - len(list_intersect(a.nt, b.nt)))"
PAIRS = f"""pairs AS (
  SELECT a.item_id AS source, b.item_id AS target, b.stars, least(1.0, greatest(0.0, list_cosine_similarity(a.v, b.v))) AS semantic,
    CASE WHEN {_INTER} > 0 THEN {_INTER} / (2 * {_UNION} - {_INTER}) ELSE 0.0 END AS tag_overlap,
    CASE WHEN a.list_id = b.list_id THEN 1.0 ELSE 0.0 END AS same_list, CASE WHEN a.language = b.language AND a.language <> '' THEN 1.0 ELSE 0.0 END AS same_language
  FROM normed a JOIN normed b ON a.item_id <> b.item_id)"""
SCORED = "scored AS (SELECT *, least(1.0, greatest(0.0, 0.65 * semantic + 0.2 * tag_overlap + 0.1 * same_list + 0.05 * same_language)) AS score FROM pairs)"
RELATED = f"""near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY semantic DESC, stars DESC, target) AS rn FROM scored) WHERE rn <= 100),
related AS (SELECT source, target, semantic, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, semantic DESC, stars DESC, target) AS rank
  FROM near WHERE semantic >= {MIN_SEMANTIC} AND score >= {MIN_SCORE})"""
EDGES = f"""tops AS (SELECT source, target, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, semantic DESC, stars DESC, target) AS rn FROM scored WHERE score >= {THRESHOLD}),
edges AS (SELECT least(source, target) AS source, greatest(source, target) AS target, max(round(score, 12)) AS weight FROM tops WHERE rn <= {DEGREE} GROUP BY 1, 2),
indexed AS (SELECT *, row_number() OVER (ORDER BY weight DESC, source, target) - 1 AS edge_index FROM edges)"""
_GRAPH = (NORMED, PAIRS, SCORED)


def edges(s, d):
    return P.similarity_edges(items(s, d), THRESHOLD, DEGREE)


@query("normalize_tags", with_items(f"SELECT item_id, {sql_tags('tags')} AS tags FROM items"))
def _(s, d):
    return items(s, d).select("item_id", normalize_tags(F.col("tags")).alias("tags"))


@query("tag_union", with_items(f"SELECT item_id, {sql_tags('list_concat(tags, topics)')} AS tags FROM items"))
def _(s, d):
    return items(s, d).select("item_id", tag_union(F.col("tags"), F.col("topics")).alias("tags"))


_NEIGHBOURS = """a.item_id AS source, b.item_id AS target"""


def _neighbours(s, d):
    """Each item with the one 37 ids on: pairs for the scalar functions."""
    rows = P.prepared(items(s, d))
    other = rows.select(*(F.col(c).alias(f"b_{c}") for c in rows.columns))
    return rows.join(other, F.col("b_item_id") == F.col("item_id") + 37)


@query("tag_overlap", with_items(f"SELECT {_NEIGHBOURS}, round(CASE WHEN {_INTER} > 0 THEN {_INTER} / (2 * {_UNION} - {_INTER}) ELSE 0.0 END, 6) AS overlap FROM normed a JOIN normed b ON b.item_id = a.item_id + 37", NORMED))
def _(s, d):
    return _neighbours(s, d).select(F.col("item_id").alias("source"), F.col("b_item_id").alias("target"), F.round(tag_overlap(F.col("norm_tags"), F.col("b_norm_tags")), 6).alias("overlap"))


@query("cosine", with_items(f"SELECT {_NEIGHBOURS}, round(list_cosine_similarity(a.v, b.v), 6) AS raw, round(greatest(0.0, list_cosine_similarity(a.v, b.v)), 6) AS clipped FROM normed a JOIN normed b ON b.item_id = a.item_id + 37", NORMED))
def _(s, d):
    return _neighbours(s, d).select(
        F.col("item_id").alias("source"), F.col("b_item_id").alias("target"),
        F.round(rel.cosine_raw(F.col("v"), F.col("b_v")), 6).alias("raw"), F.round(rel.cosine01(F.col("v"), F.col("b_v")), 6).alias("clipped"),
    )


def _signals():
    return (
        rel.cosine01(F.col("v"), F.col("b_v")), tag_overlap(F.col("norm_tags"), F.col("b_norm_tags")),
        rel.same(F.col("list_id"), F.col("b_list_id")), rel.same(F.col("language"), F.col("b_language")),
    )


@query("relevance_score", with_items("SELECT source, target, round(score, 6) AS score FROM scored WHERE target = source + 37", *_GRAPH))
def _(s, d):
    return _neighbours(s, d).select(F.col("item_id").alias("source"), F.col("b_item_id").alias("target"), F.round(rel.score(*_signals()), 6).alias("score"))


@query(
    "relevance_reasons",
    with_items("""SELECT source, target, list_filter([CASE WHEN semantic >= 0.78 THEN 'semantic:very-high' WHEN semantic >= 0.65 THEN 'semantic:high' WHEN semantic >= 0.5 THEN 'semantic:medium' END,
      CASE WHEN tag_overlap >= 0.45 THEN 'tags:high-overlap' WHEN tag_overlap > 0 THEN 'tags:overlap' END, CASE WHEN same_list > 0 THEN 'same-star-list' END,
      CASE WHEN same_language > 0 THEN 'same-language' END], lambda x: x IS NOT NULL) AS reasons FROM scored WHERE target = source + 37""", *_GRAPH),
)
def _(s, d):
    return _neighbours(s, d).select(F.col("item_id").alias("source"), F.col("b_item_id").alias("target"), rel.reasons(*_signals()).alias("reasons"))


@query("related_items", with_items("SELECT source, target, round(semantic, 6) AS semantic, round(score, 6) AS score, rank FROM related WHERE rank <= 20", *_GRAPH, RELATED))
def _(s, d):
    out = P.related_items(items(s, d), 20, MIN_SCORE, MIN_SEMANTIC)
    return out.select("source", "target", F.round("semantic", 6).alias("semantic"), F.round("score", 6).alias("score"), "rank")


@query("pairwise_relevance", with_items(f"SELECT source, target, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, semantic DESC, stars DESC, target) AS rn FROM scored WHERE score >= 0.3) WHERE rn <= 30", *_GRAPH))
def _(s, d):
    rows = P.prepared(items(s, d))
    return P.block_top(rows, rows, 30, min_score=0.3).select("source", "target", F.round("score", 6).alias("score"))


@query("similarity_graph", with_items("SELECT source, target, round(weight, 6) AS weight FROM edges", *_GRAPH, EDGES))
def _(s, d):
    return edges(s, d).select("source", "target", F.round("weight", 6).alias("weight"))


@query("edge_order", with_items("SELECT source, target, edge_index FROM (SELECT source, target, row_number() OVER (ORDER BY weight DESC, source, target) - 1 AS edge_index FROM edges)", *_GRAPH, EDGES))
def _(s, d):
    return G.indexed(edges(s, d)).select("source", "target", "edge_index")


@query("edge_page", with_items("SELECT source, target, edge_index, CASE WHEN (SELECT max(edge_index) FROM indexed) >= 150 THEN CAST(150 AS BIGINT) END AS next_cursor FROM indexed WHERE edge_index BETWEEN 100 AND 149", *_GRAPH, EDGES))
def _(s, d):
    return G.edge_page(G.indexed(edges(s, d)), 100, 50).select("source", "target", "edge_index", "next_cursor")


@query("undirected_dedup", "SELECT least(l_partkey, l_suppkey) AS source, greatest(l_partkey, l_suppkey) AS target, max(l_quantity) AS weight FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2")
def _(s, d):
    rows = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_quantity").alias("weight"))
    return G.undirected(rows)


@query("induced_edges", with_items("SELECT source, target FROM edges WHERE source IN (SELECT item_id FROM items WHERE stars > 150000) AND target IN (SELECT item_id FROM items WHERE stars > 150000)", *_GRAPH, EDGES))
def _(s, d):
    return G.induced(edges(s, d), items(s, d).where("stars > 150000")).select("source", "target")


@query("dangling_edges", with_items("SELECT source, target FROM edges WHERE source NOT IN (SELECT item_id FROM items WHERE stars > 150000) OR target NOT IN (SELECT item_id FROM items WHERE stars > 150000)", *_GRAPH, EDGES))
def _(s, d):
    return G.dangling(edges(s, d), items(s, d).where("stars > 150000")).select("source", "target")


@query("visible_clusters", with_items("SELECT cluster_id, name FROM clusters WHERE cluster_id IN (SELECT cluster_id FROM items WHERE stars > 490000)", CLUSTERS))
def _(s, d):
    return G.visible_clusters(clusters(s, d), items(s, d).where("stars > 490000")).select("cluster_id", "name")


@query("cluster_color", with_items("""SELECT cluster_id, coalesce(color, ['#FF6B6B','#4ECDC4','#45B7D1','#96CEB4','#FFEAA7','#DDA0DD','#98D8C8','#F7DC6F','#BB8FCE','#85C1E9','#F8B500','#00CED1']
  [(row_number() OVER (ORDER BY cluster_id) - 1) % 12 + 1]) AS color FROM clusters""", CLUSTERS))
def _(s, d):
    return G.cluster_colors(clusters(s, d))


@query("top_starred_cap", with_items("SELECT item_id, stars FROM items ORDER BY stars DESC, item_id LIMIT 100"))
def _(s, d):
    return G.top_starred(items(s, d), 100).select("item_id", "stars")


@query("top_clusters", with_items("SELECT cluster_id, name, item_count FROM clusters ORDER BY item_count DESC, cluster_id LIMIT 8", CLUSTERS))
def _(s, d):
    return clusters(s, d).orderBy(F.desc("item_count"), "cluster_id").limit(8).select("cluster_id", "name", "item_count")


@query(
    "adaptive_threshold",
    with_items("""SELECT round(quantile_cont(score, greatest(0.05, least(0.98, 1 - 8 / 199.0))), 6) AS raw,
      round(least(0.85, greatest(0.35, quantile_cont(score, greatest(0.05, least(0.98, 1 - 8 / 199.0))))), 6) AS threshold FROM scored
      WHERE source < target AND source IN (SELECT item_id FROM items ORDER BY stars DESC, item_id LIMIT 200) AND target IN (SELECT item_id FROM items ORDER BY stars DESC, item_id LIMIT 200)""", *_GRAPH),
)
def _(s, d):
    return P.adaptive_threshold(items(s, d)).select(F.round("raw", 6).alias("raw"), F.round("threshold", 6).alias("threshold"))


@query(
    "same_tag_items",
    with_items("""SELECT item_id, target, reason, rank FROM (SELECT item_id, target, reason, row_number() OVER (PARTITION BY item_id ORDER BY stars DESC, target) AS rank FROM met) WHERE rank <= 10""",
      """own AS (SELECT DISTINCT item_id, stars, len(list_distinct(topics)) AS n, t FROM items, unnest(topics) AS u(t))""",
      """met AS (SELECT a.item_id, b.item_id AS target, any_value(b.stars) AS stars, (list(a.t ORDER BY a.t))[1:2] AS reason FROM own a JOIN own b ON a.t = b.t AND a.item_id <> b.item_id
        GROUP BY 1, 2 HAVING count(*) / least(any_value(a.n), any_value(b.n)) >= 0.25)"""),
)
def _(s, d):
    return P.same_tag_items(items(s, d)).select("item_id", "target", "reason", "rank")


@query("same_language_top", with_items("""SELECT a.item_id, b.item_id AS target, row_number() OVER (PARTITION BY a.item_id ORDER BY b.stars DESC, b.item_id) AS rank FROM items a JOIN items b
  ON a.language = b.language AND a.item_id <> b.item_id AND a.language <> '' QUALIFY rank <= 10"""))
def _(s, d):
    return P.same_language_top(items(s, d))


@query("semantic_search", with_items("""SELECT item_id, round(list_cosine_similarity(v, (SELECT v FROM normed WHERE item_id = 3)), 6) AS similarity FROM normed
  WHERE item_id IN (SELECT item_id FROM items WHERE stars > 50000) ORDER BY list_cosine_similarity(v, (SELECT v FROM normed WHERE item_id = 3)) DESC, item_id LIMIT 25""", NORMED))
def _(s, d):
    it = items(s, d)
    found = it.where("item_id = 3").select("embedding").head()
    members = it.where("stars > 50000").select("item_id")
    rows = it.join(members, "item_id", "left_semi")
    return P.semantic_search(rows, [float(x) for x in found.embedding], 25).select("item_id", F.round("similarity", 6).alias("similarity"))


@query("restrict_to_snapshot", with_items("SELECT item_id, name FROM items WHERE item_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"))
def _(s, d):
    members = s.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("item_id"))
    return items(s, d).join(members, "item_id", "left_semi").select("item_id", "name")


KNN = """nn AS (SELECT a.item_id AS source, b.item_id AS target, least(1.0, greatest(0.0, list_cosine_similarity(a.v, b.v))) AS semantic,
  row_number() OVER (PARTITION BY a.item_id ORDER BY least(1.0, greatest(0.0, list_cosine_similarity(a.v, b.v))) DESC, b.stars DESC, b.item_id) AS rank
  FROM normed a JOIN normed b ON a.item_id % 10 = 0 AND b.item_id % 10 <> 0 QUALIFY rank <= 5)"""


@query("knn_join", with_items("SELECT source, target, round(semantic, 6) AS semantic, rank FROM nn", NORMED, KNN))
def _(s, d):
    rows = P.prepared(items(s, d))
    return P.knn(rows.where("item_id % 10 = 0"), rows.where("item_id % 10 <> 0")).select("source", "target", F.round("semantic", 6).alias("semantic"), "rank")


@query("ivf_candidates")
def _(s, d):
    it = items(s, d)
    return P.ivf_candidates(it, k=8, lists=20, probes=12).select("item_id", "target", F.round("similarity", 6).alias("similarity"), "rank")


def _every_list(s, d):
    """An index of 13 lists; all of them probed, it has to find what the exact jobs find."""
    return build(P.prepared(items(s, d)), 13)


@query("related_items_by_lists", with_items("SELECT source, target, round(semantic, 6) AS semantic, round(score, 6) AS score, rank FROM related WHERE rank <= 20", *_GRAPH, RELATED))
def _(s, d):
    out = P.related_items(items(s, d), 20, MIN_SCORE, MIN_SEMANTIC, candidates=_every_list(s, d), probes=13)
    return out.select("source", "target", F.round("semantic", 6).alias("semantic"), F.round("score", 6).alias("score"), "rank")


@query("similarity_graph_by_lists", with_items("SELECT source, target, round(weight, 6) AS weight FROM edges", *_GRAPH, EDGES))
def _(s, d):
    out = P.similarity_edges(items(s, d), THRESHOLD, DEGREE, candidates=_every_list(s, d), probes=13)
    return out.select("source", "target", F.round("weight", 6).alias("weight"))


@query("knn_by_lists", with_items("SELECT source, target, round(semantic, 6) AS semantic, rank FROM nn", NORMED, KNN))
def _(s, d):
    rows = P.prepared(items(s, d))
    old = rows.where("item_id % 10 <> 0")
    out = P.knn(rows.where("item_id % 10 = 0"), old, candidates=build(old, 13), probes=13)
    return out.select("source", "target", F.round("semantic", 6).alias("semantic"), "rank")


@query("stored_lists", with_items("SELECT item_id, stars FROM items"))
def _(s, d):
    """An index written and read again: every item is in one list."""
    path = f"{shared_dir(s).rstrip('/')}/index-{uuid.uuid4().hex}"
    build(P.prepared(items(s, d))).save(path)
    return ListIndex.load(s, path).postings.select("item_id", "stars")
