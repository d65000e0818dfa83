"""Queries over filters, search, sorting, paging and joins of the item table."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfolio.functions.numbers import node_size
from kinfolio.functions.text import search_text
from kinfolio.operators import browse as B
from kinfolio.plans.base import CLUSTERS, LISTS, clusters, items, lists, query, table, with_items

_SHOWN = "item_id, name, language, stars"


def _ids(body: str, *more: str) -> str:
    return with_items(body, *more)


@query("filter_cluster", _ids("SELECT item_id, cluster_id FROM items WHERE cluster_id IN (1, 3, 5)"))
def _(s, d):
    return items(s, d).where(B.in_clusters([1, 3, 5], 9)).select("item_id", "cluster_id")


@query("filter_language", _ids("SELECT item_id, language FROM items WHERE language = 'ECONOMY'"))
def _(s, d):
    return items(s, d).where(B.in_language("ECONOMY")).select("item_id", "language")


@query("filter_min_stars", _ids("SELECT item_id, stars FROM items WHERE stars >= 200000"))
def _(s, d):
    return items(s, d).where(B.min_stars(200000)).select("item_id", "stars")


@query("stars_query", _ids("SELECT item_id, stars FROM items WHERE stars > 300000"))
def _(s, d):
    return items(s, d).where(B.matches(" Stars:> 300000")).select("item_id", "stars")


@query(
    "text_search",
    _ids("""SELECT item_id, name FROM items WHERE name ILIKE '%r_d%' OR full_name ILIKE '%r_d%' OR description ILIKE '%r_d%' OR language ILIKE '%r_d%'
      OR concat('{', array_to_string(tags, ','), '}') ILIKE '%r_d%' OR concat('{', array_to_string(topics, ','), '}') ILIKE '%r_d%'"""),
)
def _(s, d):
    return items(s, d).where(B.matches("r_d")).select("item_id", "name")


@query("text_search_literal", _ids("""SELECT item_id, name FROM items WHERE contains(lower(name), 'widget') OR contains(lower(full_name), 'widget')
  OR contains(lower(description), 'widget') OR contains(lower(coalesce(language, '')), 'widget')
  OR contains(lower(array_to_string(tags, ',')), 'widget') OR contains(lower(array_to_string(topics, ',')), 'widget')"""))
def _(s, d):
    return items(s, d).where(B.matches("Widget", literal=True)).select("item_id", "name")


@query("month_window", _ids("SELECT item_id, starred_at FROM items WHERE starred_at >= '1997-12-01' AND starred_at < '1998-01-01'"))
def _(s, d):
    return items(s, d).where(B.in_month("1997-12")).select("item_id", "starred_at")


@query("has_topic", _ids("SELECT item_id, name FROM items WHERE len(list_filter(topics, lambda t: lower(trim(t)) = 'ring')) > 0"))
def _(s, d):
    return items(s, d).where(B.has_topic(" Ring ")).select("item_id", "name")


@query(
    "browse_items",
    _ids("""SELECT item_id, name, language, stars, (SELECT count(*) FROM items WHERE stars >= 100000 AND language = 'ECONOMY') AS filtered_count,
      (SELECT count(*) FROM items) AS total_count FROM items WHERE stars >= 100000 AND language = 'ECONOMY' ORDER BY stars DESC NULLS FIRST, item_id DESC LIMIT 20 OFFSET 5"""),
)
def _(s, d):
    rows = B.browse(items(s, d), B.min_stars(100000), B.in_language("ECONOMY"), sort="stars", limit=20, offset=5)
    return rows.select("item_id", "name", "language", "stars", "filtered_count", "total_count")


@query(
    "list_items",
    _ids("""SELECT item_id, language, (SELECT count(*) FROM items WHERE cluster_id = 2) > 40 AS has_more FROM items WHERE cluster_id = 2
      ORDER BY language ASC NULLS LAST, item_id LIMIT 20 OFFSET 20"""),
)
def _(s, d):
    return B.list_page(items(s, d), B.in_clusters(None, 2), sort="language", descending=False, number=2, per_page=20).select("item_id", "language", "has_more")


@query("get_item", _ids("SELECT item_id, name, language, stars FROM items WHERE item_id = 42"))
def _(s, d):
    return items(s, d).where("item_id = 42").select("item_id", "name", "language", "stars")


@query(
    "visible_nodes",
    _ids("""SELECT item_id FROM items WHERE cluster_id IN (0, 1, 2, 3, 4) AND list_id BETWEEN 1 AND 20 AND language IN ('ECONOMY', 'SMALL', 'STANDARD') AND stars >= 50000
      AND strftime(starred_at, '%Y-%m') BETWEEN '1996-01' AND '2000-06'"""),
)
def _(s, d):
    return B.visible_nodes(items(s, d), [0, 1, 2, 3, 4], list(range(1, 21)), ["ECONOMY", "SMALL", "STANDARD"], 50000, "", ("1996-01", "2000-06")).select("item_id")


@query(
    "search_text",
    _ids("""SELECT item_id, lower(array_to_string(list_filter(list_concat([full_name, name, language], tags, topics), lambda x: x IS NOT NULL AND trim(x) <> ''), chr(10))) AS search_text FROM items"""),
)
def _(s, d):
    text = search_text(F.col("full_name"), F.col("name"), F.col("language"), lists=(F.col("tags"), F.col("topics")))
    return items(s, d).select("item_id", text.alias("search_text"))


@query("match_cluster", with_items("""SELECT cluster_id, name FROM clusters WHERE contains(lower(name), 'wid') OR contains(lower(description), 'wid')
  OR len(list_filter(keywords, lambda k: contains(lower(k), 'wid'))) > 0""", CLUSTERS))
def _(s, d):
    return B.match_clusters(clusters(s, d), " Wid ").select("cluster_id", "name")


@query("match_facet", _ids("SELECT language AS value, count(*) AS n FROM items WHERE contains(lower(language), 'ec') GROUP BY 1 ORDER BY n DESC, value LIMIT 5"))
def _(s, d):
    return B.facet(items(s, d), F.col("language"), "EC", 5)


@query(
    "graph_nodes",
    with_items(
        """, colored AS (SELECT cluster_id, coalesce(color, ['#FF6B6B','#4ECDC4','#45B7D1','#96CEB4','#FFEAA7','#DDA0DD','#98D8C8','#F7DC6F','#BB8FCE','#85C1E9','#F8B500','#00CED1']
          [(row_number() OVER (ORDER BY cluster_id) - 1) % 12 + 1]) AS color FROM clusters)
        SELECT i.item_id, round(1.0 + log10(greatest(stars, 1)) * 0.5, 6) AS size, coalesce(c.color, '#808080') AS color, coalesce(i.list_id, -1) AS list_id,
          CASE WHEN i.list_id IS NULL THEN 'Uncategorized' ELSE l.list_name END AS list_name
        FROM items i LEFT JOIN colored c USING (cluster_id) LEFT JOIN lists l ON l.list_id = i.list_id""",
        CLUSTERS,
        LISTS,
    ).replace("\n, colored", ", colored"),
)
def _(s, d):
    from kinfolio.operators.graph import cluster_colors

    colored = items(s, d).join(cluster_colors(clusters(s, d)), "cluster_id", "left")
    named = B.join_lists(colored, lists(s, d))
    return named.select("item_id", F.round(node_size(F.col("stars")), 6).alias("size"), F.coalesce("color", F.lit("#808080")).alias("color"), "list_id", "list_name")


@query("pending_embedding", """SELECT d.doc_id, l.doc_id IS NULL AS needs_enrichment FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id
  WHERE e.vec_id IS NULL""")
def _(s, d):
    docs = table(s, d, "documents").select("doc_id").join(table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    known = table(s, d, "labels").select("doc_id", F.lit("s").alias("summary"), F.array(F.lit("t")).alias("tags"))
    return B.pending(docs.join(known, "doc_id", "left")).select("doc_id", "needs_enrichment")


@query("drop_unembedded_layout", """SELECT p_partkey AS item_id, CASE WHEN vec_id IS NOT NULL THEN p_size END AS cluster_id FROM part LEFT JOIN embeddings ON vec_id = p_partkey""")
def _(s, d):
    rows = table(s, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_size").alias("cluster_id"))
    rows = rows.join(table(s, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding"), "item_id", "left")
    return B.drop_unembedded_layout(rows, "cluster_id").select("item_id", "cluster_id")


@query("order_items", _ids("SELECT item_id, language FROM items ORDER BY language DESC NULLS FIRST, item_id DESC LIMIT 100"))
def _(s, d):
    return B.page(B.ordered(items(s, d).select("item_id", "language", "starred_at"), "language"), 100).select("item_id", "language")


@query("paginate", _ids("SELECT item_id, stars FROM items ORDER BY starred_at DESC NULLS FIRST, item_id DESC LIMIT 50 OFFSET 100"))
def _(s, d):
    return B.page(B.ordered(items(s, d).select("item_id", "stars", "starred_at"), "nonsense"), 50, 100).select("item_id", "stars")


@query("scan_user_items", "SELECT user_id, event_id, event_type FROM events WHERE user_id = 8")
def _(s, d):
    return table(s, d, "events").where("user_id = 8").select("user_id", "event_id", "event_type")


@query(
    "merge_search_results",
    with_items("""SELECT item_id, min(source) AS source FROM (SELECT item_id, 0 AS source FROM items WHERE contains(lower(name), 'ring')
      UNION ALL SELECT item_id, 1 FROM items WHERE cluster_id = 1) GROUP BY item_id"""),
)
def _(s, d):
    it = items(s, d)
    hits = it.where(F.lower("name").contains("ring")).select("item_id", F.col("stars").alias("position"))
    close = it.where("cluster_id = 1").select("item_id", F.col("stars").alias("position"))
    return B.merged_results(hits, close).select("item_id", "source")


@query(
    "palette_union",
    with_items(
        """(SELECT 'item' AS kind, CAST(item_id AS VARCHAR) AS value, stars AS n FROM items WHERE contains(lower(name), 'e') ORDER BY stars DESC, item_id LIMIT 5)
        UNION ALL (SELECT 'cluster', name, item_count FROM clusters ORDER BY item_count DESC, name LIMIT 5)
        UNION ALL (SELECT 'language', language, count(*) AS n FROM items WHERE contains(lower(language), 'e') GROUP BY 2 ORDER BY n DESC, 2 LIMIT 5)
        UNION ALL (SELECT 'tag', t, count(*) AS n FROM items, unnest(topics) AS u(t) WHERE contains(lower(t), 'e') GROUP BY 2 ORDER BY n DESC, 2 LIMIT 5)""",
        CLUSTERS,
    ),
)
def _(s, d):
    it = items(s, d)
    hits = it.where(F.lower("name").contains("e")).orderBy(F.desc("stars"), "item_id").limit(5)
    parts = [
        hits.select(F.lit("item").alias("kind"), F.col("item_id").cast("string").alias("value"), F.col("stars").alias("n")),
        clusters(s, d).orderBy(F.desc("item_count"), "name").limit(5).select(F.lit("cluster").alias("kind"), F.col("name").alias("value"), F.col("item_count").alias("n")),
        B.facet(it, F.col("language"), "e", 5).select(F.lit("language").alias("kind"), "value", "n"),
        B.facet(it, F.explode("topics"), "e", 5).select(F.lit("tag").alias("kind"), "value", "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
