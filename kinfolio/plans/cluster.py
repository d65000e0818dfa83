"""Queries over clustering, naming, outliers and layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfolio.functions import numbers as N
from kinfolio.functions.relevance import l2_normalized
from kinfolio.functions.text import sanitize_name
from kinfolio.operators import cluster as C
from kinfolio.operators import pairs as P
from kinfolio.operators.lists import build
from kinfolio.operators.quantiles import percentiles
from kinfolio.operators.ward import cut_tree, tree
from kinfolio.plans.base import CLUSTERS, clusters, items, query, table, with_items
from kinfolio.plans.graph import KNN, NORMED, sql_tags

UNIT = "unit AS (SELECT item_id, cluster_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS x FROM items)"
MEANS = "means AS (SELECT cluster_id, pos, avg(v) AS m FROM (SELECT cluster_id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS pos FROM unit) GROUP BY ALL)"
SCORES = """d AS (SELECT item_id, cluster_id, sqrt(sum((v - m) * (v - m))) AS dist FROM (SELECT item_id, cluster_id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS pos FROM unit)
  JOIN means USING (cluster_id, pos) GROUP BY ALL),
med AS (SELECT cluster_id, median(dist) AS med FROM d GROUP BY 1 HAVING count(*) >= 8),
mad AS (SELECT cluster_id, median(abs(dist - med)) + 1e-6 AS mad FROM d JOIN med USING (cluster_id) GROUP BY 1),
scores AS (SELECT item_id, cluster_id, (dist - med) / mad AS score FROM d JOIN med USING (cluster_id) JOIN mad USING (cluster_id))"""


def unit(s, d):
    return items(s, d).select("item_id", "cluster_id", l2_normalized(F.col("embedding")).alias("x"))


def _points(rows, key, column):
    return rows.select(key, F.posexplode(column).alias("pos", "v"))


@query("l2_normalize", with_items("SELECT item_id, round(x[1], 6) AS first, round(list_sum(list_transform(x, lambda y: y * y)), 6) AS norm FROM unit", UNIT))
def _(s, d):
    return unit(s, d).select("item_id", F.round(F.col("x")[0], 6).alias("first"), F.round(F.aggregate("x", F.lit(0.0), lambda a, y: a + y * y), 6).alias("norm"))


@query(
    "cluster_centroids",
    with_items("SELECT cluster_id, pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY cluster_id)), 6) AS v FROM means", UNIT, MEANS),
)
def _(s, d):
    rows = unit(s, d)
    found = C.centroids(rows.drop("cluster_id"), rows.select("item_id", "cluster_id"))
    return found.select("cluster_id", F.posexplode("center").alias("pos", "v")).withColumn("v", F.round("v", 6))


@query("outlier_scores", with_items("SELECT item_id, round(score, 5) AS score FROM scores", UNIT, MEANS, SCORES))
def _(s, d):
    rows = unit(s, d)
    return C.outlier_scores(rows.drop("cluster_id"), rows.select("item_id", "cluster_id")).select("item_id", F.round("score", 5).alias("score"))


@query("outlier_scores_refined", with_items("SELECT item_id, round(score, 5) AS score FROM scores", UNIT, MEANS, SCORES))
def _(s, d):
    """The same scores with every cluster's medians found by refined histograms, as a hot cluster's are."""
    rows = unit(s, d)
    return C.outlier_scores(rows.drop("cluster_id"), rows.select("item_id", "cluster_id"), large=1).select("item_id", F.round("score", 5).alias("score"))


@query("exact_percentiles", """SELECT l_returnflag AS value, round(quantile_cont(l_extendedprice, 0.9), 4) AS price, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1""")
def _(s, d):
    rows = table(s, d, "lineitem").select(F.col("l_returnflag").alias("value"), F.col("l_extendedprice").cast("double").alias("x"))
    sizes = rows.groupBy("value").agg(F.count("*").alias("n"))
    return percentiles(rows, "value", "x", 0.9, "p", large=1).join(sizes, "value").select("value", F.round("p", 4).alias("price"), "n")


@query(
    "mark_outliers",
    with_items("""SELECT i.item_id, CAST(CASE WHEN w.item_id IS NOT NULL THEN -1 ELSE i.cluster_id END AS BIGINT) AS cluster_id FROM items i LEFT JOIN (
      SELECT item_id FROM scores WHERE score > 2.0 ORDER BY score DESC, item_id DESC
      LIMIT (SELECT CAST(floor(greatest(1, least(count(*) FILTER (score > 2.0), 0.02 * (SELECT count(*) FROM items)))) AS BIGINT) FROM scores)) w ON w.item_id = i.item_id""", UNIT, MEANS, SCORES),
)
def _(s, d):
    rows = unit(s, d)
    return C.mark_outliers(rows.drop("cluster_id"), rows.select("item_id", "cluster_id"), limit=2.0, ratio=0.02)


@query("contiguous_labels", with_items("SELECT item_id, CAST(CASE WHEN c = -1 THEN -1 ELSE n END AS BIGINT) AS cluster_id FROM l LEFT JOIN (SELECT c, row_number() OVER (ORDER BY c) - 1 AS n FROM (SELECT DISTINCT c FROM l WHERE c <> -1)) USING (c)",
  "l AS (SELECT item_id, CASE WHEN cluster_id % 3 = 0 THEN -1 ELSE cluster_id * 7 END AS c FROM items)"))
def _(s, d):
    rows = items(s, d).select("item_id", F.when(F.col("cluster_id") % 3 == 0, -1).otherwise(F.col("cluster_id") * 7).alias("cluster_id"))
    return C.contiguous(rows)


@query("merge_clusters")
def _(s, d):
    rows = unit(s, d)
    return C.merged(rows.drop("cluster_id"), rows.select("item_id", "cluster_id"), threshold=0.3, most=4, forced=-1.0)


@query("estimate_clusters", with_items("SELECT cluster_id, CAST(least(greatest(3, least(floor(sqrt(count(*))), count(*), 20)), count(*)) AS BIGINT) AS k FROM items GROUP BY 1"))
def _(s, d):
    return items(s, d).groupBy("cluster_id").agg(F.count("*").alias("n")).select("cluster_id", N.estimate_clusters(F.col("n")).alias("k"))


@query("force_full", with_items("SELECT cluster_id, (count(*) FILTER (stars > 400000)) / count(*) > 0.2 AS full_run FROM items GROUP BY 1"))
def _(s, d):
    counted = items(s, d).groupBy("cluster_id").agg(F.count("*").alias("total"), F.count_if(F.col("stars") > 400000).alias("new"))
    return counted.select("cluster_id", N.force_full(F.col("total"), F.col("new"), F.lit(None).cast("double")).alias("full_run"))


@query("cluster_params", with_items("""SELECT name, most AS target_max_clusters, CASE WHEN least IS NULL THEN greatest(2, most // 3) ELSE greatest(2, least(least, most)) END AS min_clusters, size AS min_cluster_size,
  greatest(1, least(3, size // 3)) AS min_samples, greatest(15, least(60, 60 - 2 * most)) AS n_neighbors FROM
  (SELECT name, greatest(2, least(20, stars % 30)) AS most, CASE WHEN stars % 2 = 0 THEN stars % 23 END AS least, greatest(3, least(10, n // 20)) AS size FROM
    (SELECT name, count(*) * 7 AS n, max(stars) AS stars FROM items GROUP BY 1))"""))
def _(s, d):
    counted = items(s, d).groupBy("name").agg((F.count("*") * 7).alias("n"), F.max("stars").alias("stars"))
    least = F.when(F.col("stars") % 2 == 0, F.col("stars") % 23)
    return counted.select("name", N.cluster_params(F.col("n"), F.col("stars") % 30, least).alias("p")).select("name", "p.*")


@query("node_sizes", with_items("""SELECT item_id, round(1 + 0.5 * log10(greatest(stars, 1)), 6) AS size, round(least(0.5 * log10(greatest(stars, 1) + 1) + 0.5, 3), 6) AS layout,
  round(greatest(5, least(30, 5 * log10(greatest(stars, 1) + 1))), 6) AS radius FROM items"""))
def _(s, d):
    stars = F.col("stars")
    return items(s, d).select("item_id", F.round(N.node_size(stars), 6).alias("size"), F.round(N.layout_size(stars), 6).alias("layout"), F.round(N.node_radius(stars), 6).alias("radius"))


_STOPS = "'a','an','the','is','are','for','to','and','or','of','in','on','with'"
NAMING = f"""tt AS (SELECT cluster_id, t, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min(row(-stars, full_name, item_id, pos))) AS rn
  FROM (SELECT cluster_id, stars, full_name, item_id, unnest({sql_tags('topics')}) AS t, generate_subscripts({sql_tags('topics')}, 1) AS pos FROM items) GROUP BY cluster_id, t),
ww AS (SELECT cluster_id, w, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min(row(-stars, full_name, item_id, pos))) AS rn
  FROM (SELECT cluster_id, stars, full_name, item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT *, string_split_regex(regexp_replace(lower(description), '^\\s+|\\s+$', '', 'g'), '\\s+') AS ws FROM items))
  WHERE length(w) > 2 AND w NOT IN ({_STOPS}) GROUP BY cluster_id, w)"""


@query("topic_counts", with_items("SELECT cluster_id, t AS value, rn AS rank FROM tt WHERE rn <= 5", NAMING))
def _(s, d):
    return C.topic_and_word_counts(items(s, d))[0].select("cluster_id", "value", "rank")


@query("word_counts", with_items("SELECT cluster_id, w AS value, rn AS rank FROM ww WHERE rn <= 3", NAMING))
def _(s, d):
    return C.topic_and_word_counts(items(s, d))[1].select("cluster_id", "value", "rank")


@query(
    "heuristic_names",
    with_items("""SELECT cluster_id, n AS item_count, concat(upper(left(a[1], 1)), a[1][2:], ' / ', upper(left(a[2], 1)), a[2][2:]) AS name,
      concat('A cluster of ', n, ' repositories related to ', array_to_string(a[1:3], ', ')) AS description, list_filter(list_concat(a, b), lambda k, i: list_position(list_concat(a, b), k) = i) AS keywords
      FROM (SELECT cluster_id, count(*) AS n FROM items GROUP BY 1) JOIN (SELECT cluster_id, list(t ORDER BY rn) AS a FROM tt WHERE rn <= 5 GROUP BY 1) USING (cluster_id)
      JOIN (SELECT cluster_id, list(w ORDER BY rn) AS b FROM ww WHERE rn <= 3 GROUP BY 1) USING (cluster_id)""", NAMING),
)
def _(s, d):
    return C.heuristic_names(items(s, d))


@query("sanitize_names", "SELECT p_partkey AS item_id, concat(p_brand, ' / ', regexp_replace(p_name, ' ', '工具', 'g')) AS name FROM part")
def _(s, d):
    raw = F.concat(F.lit(" - "), F.col("p_brand"), F.lit("  & "), F.regexp_replace("p_name", " ", "工具集"), F.lit(" _/"))
    return table(s, d, "part").select(F.col("p_partkey").alias("item_id"), sanitize_name(raw).alias("name"))


@query(
    "unique_cluster_names",
    with_items("""SELECT CAST(cluster_id AS BIGINT) AS cluster_id, CASE WHEN rn = 1 THEN concat('group ', cluster_id % 2) WHEN rn2 = 1 THEN concat('group ', cluster_id % 2, ' · ', keywords[1])
      ELSE concat('group ', cluster_id % 2, ' · ', keywords[1], rn2) END AS name FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id % 2, rn > 1, keywords[1] ORDER BY item_count DESC, cluster_id) AS rn2
      FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id % 2 ORDER BY item_count DESC, cluster_id) AS rn FROM clusters))""", CLUSTERS),
)
def _(s, d):
    rows = clusters(s, d).withColumn("name", F.concat(F.lit("group "), (F.col("cluster_id") % 2).cast("string")))
    return C.unique_names(rows).select("cluster_id", "name")


@query("naming_order", with_items("SELECT cluster_id, full_name, row_number() OVER (PARTITION BY cluster_id ORDER BY stars DESC, full_name, item_id) AS rank FROM items QUALIFY rank <= 10"))
def _(s, d):
    return C.naming_order(items(s, d), 10).select("cluster_id", "full_name", "rank")


@query(
    "cluster_context",
    with_items("""SELECT cluster_id, top_items, topics, languages FROM
      (SELECT cluster_id, list(full_name ORDER BY rn) AS top_items FROM (SELECT cluster_id, full_name, row_number() OVER (PARTITION BY cluster_id ORDER BY stars DESC, item_id) AS rn FROM items) WHERE rn <= 10 GROUP BY 1)
      JOIN (SELECT cluster_id, list(t ORDER BY rn) AS topics FROM (SELECT cluster_id, t, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, t) AS rn FROM items, unnest(topics) AS u(t) GROUP BY 1, 2) WHERE rn <= 20 GROUP BY 1) USING (cluster_id)
      JOIN (SELECT cluster_id, list(language ORDER BY rn) AS languages FROM (SELECT cluster_id, language, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, language) AS rn FROM items WHERE language IS NOT NULL GROUP BY 1, 2) GROUP BY 1) USING (cluster_id)"""),
)
def _(s, d):
    return C.cluster_context(items(s, d)).select("cluster_id", "top_items", "topics", "languages")


@query(
    "assign_incrementally",
    with_items("""SELECT source AS item_id, arg_min(o.cluster_id, rank) AS cluster_id, round(sum(o.stars / 1e5 * w) / sum(w), 6) AS x FROM (SELECT *, least(1.0, greatest(0.01, semantic)) AS w FROM nn) n
      JOIN items o ON o.item_id = n.target GROUP BY 1""", NORMED, KNN),
)
def _(s, d):
    rows = P.prepared(items(s, d))
    placed = items(s, d).select("item_id", "cluster_id", (F.col("stars") / 1e5).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    old = rows.where("item_id % 10 <> 0").join(placed, "item_id")
    return C.assign_incrementally(rows.where("item_id % 10 = 0"), old, noise=0.0).select("item_id", "cluster_id", F.round("x", 6).alias("x"))


@query(
    "assign_by_lists",
    with_items("""SELECT source AS item_id, arg_min(o.cluster_id, rank) AS cluster_id, round(sum(o.stars / 1e5 * w) / sum(w), 6) AS x FROM (SELECT *, least(1.0, greatest(0.01, semantic)) AS w FROM nn) n
      JOIN items o ON o.item_id = n.target GROUP BY 1""", NORMED, KNN),
)
def _(s, d):
    """The same placement with neighbours from 13 lists, all of them probed."""
    rows = P.prepared(items(s, d))
    placed = items(s, d).select("item_id", "cluster_id", (F.col("stars") / 1e5).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    old = rows.where("item_id % 10 <> 0").join(placed, "item_id")
    index = build(rows.where("item_id % 10 <> 0"), 13, recall=1.0)
    index.probes = 13
    found = C.assign_incrementally(rows.where("item_id % 10 = 0"), old, noise=0.0, candidates=index)
    return found.select("item_id", "cluster_id", F.round("x", 6).alias("x"))


@query("cluster_centers", with_items("SELECT cluster_id, round(avg(stars / 1e5), 6) AS x, round(avg(item_id / 1e2), 6) AS y FROM items WHERE cluster_id > 0 GROUP BY 1"))
def _(s, d):
    # The cluster numbered 0 here stands for noise.
    placed = items(s, d).select((F.col("cluster_id") - 1).alias("cluster_id"), (F.col("stars") / 1e5).alias("x"), (F.col("item_id") / 1e2).alias("y"), F.lit(0.0).alias("z"))
    return C.cluster_centers(placed).select((F.col("cluster_id") + 1).alias("cluster_id"), F.round("center_x", 6).alias("x"), F.round("center_y", 6).alias("y"))


@query("pca_features")
def _(s, d):
    return C.centered_pca(unit(s, d).select("item_id", "x"), 30).select("item_id", F.size("z").alias("n"), F.round(F.abs(F.col("z")[0]), 4).alias("first"))


@query("pca_layout")
def _(s, d):
    return C.centered_pca(unit(s, d).select("item_id", "x"), 3).select("item_id", *(F.round(F.abs(F.col("z")[i] * 2), 4).alias(c) for i, c in enumerate("xyz")))


@query("hierarchical_clusters")
def _(s, d):
    return C.hierarchical(unit(s, d), 8)


@query("hierarchical_rounds")
def _(s, d):
    """The tree by rounds of reciprocal nearest neighbours, down to 250 rows before the last merges."""
    rows = unit(s, d).select("item_id", "x")
    return C.contiguous(cut_tree(rows, tree(rows, local=250, block=250), 8))


@query("build_clusters")
def _(s, d):
    return C.build_clusters(items(s, d))[1].select("cluster_id", "item_count", "name", "keywords")


@query("resolve_collisions")
def _(s, d):
    size = N.layout_size(F.col("stars"))
    nodes = items(s, d).select("item_id", *((F.col("embedding")[i].cast("double") * 8).alias(c) for i, c in enumerate("xyz")), size.alias("size"))
    return C.resolve_collisions(nodes).select("item_id", *(F.round(c, 5).alias(c) for c in "xyz"))


@query(
    "cluster_hulls",
    with_items("""SELECT DISTINCT p.cluster_id, p.x, p.y FROM pts p WHERE NOT EXISTS (SELECT 1 FROM pts a JOIN pts b ON a.cluster_id = b.cluster_id AND a.x < b.x WHERE a.cluster_id = p.cluster_id
        AND a.x <= p.x AND b.x >= p.x AND (b.x - a.x) * (p.y - a.y) <= (b.y - a.y) * (p.x - a.x) AND (a.x, a.y) <> (p.x, p.y) AND (b.x, b.y) <> (p.x, p.y)
        AND EXISTS (SELECT 1 FROM pts c JOIN pts e ON c.cluster_id = e.cluster_id AND c.x < e.x WHERE c.cluster_id = p.cluster_id AND c.x <= p.x AND e.x >= p.x
          AND (e.x - c.x) * (p.y - c.y) >= (e.y - c.y) * (p.x - c.x) AND (c.x, c.y) <> (p.x, p.y) AND (e.x, e.y) <> (p.x, p.y)))""",
      "pts AS (SELECT CAST(cluster_id AS BIGINT) AS cluster_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM items)"),
)
def _(s, d):
    pts = items(s, d).select("cluster_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return C.cluster_hulls(pts).select("cluster_id", "x", "y")
