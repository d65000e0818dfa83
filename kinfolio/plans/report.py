"""Queries over dashboards, timelines, windows and calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfolio.functions.numbers import calendar, humanized
from kinfolio.operators import browse as B
from kinfolio.operators import report as R
from kinfolio.plans.base import CLUSTERS, LISTS, clusters, items, lists, query, table, with_items


@query("status_counts", with_items("SELECT count(*) AS total, count(*) FILTER (stars > 100000) AS embedded, count(*) FILTER (language IS NOT NULL) AS summarized FROM items"))
def _(s, d):
    return R.status_counts(items(s, d), F.col("stars") > 100000, F.col("language").isNotNull())


@query("top_languages", with_items("SELECT language AS value, count(*) AS n FROM items WHERE language IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 8"))
def _(s, d):
    return R.top_values(items(s, d), F.col("language"), 8)


@query("language_stats", with_items("SELECT language AS value, count(*) AS n FROM items WHERE language IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 20"))
def _(s, d):
    return R.top_values(items(s, d), F.col("language"), 20)


@query("top_topics", with_items("SELECT lower(trim(t)) AS value, count(*) AS n FROM items, unnest(topics) AS u(t) WHERE trim(t) <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 12"))
def _(s, d):
    return R.top_values(R.topic_values(items(s, d)), F.col("topic"), 12)


@query("distinct_topics", with_items("SELECT count(DISTINCT lower(trim(t))) AS n FROM items, unnest(topics) AS u(t) WHERE trim(t) <> ''"))
def _(s, d):
    return R.topic_values(items(s, d)).agg(F.countDistinct("topic").alias("n"))


@query("dashboard_summary", with_items("""SELECT count(*) AS total, count(*) FILTER (stars > 100000) AS embedded, count(*) FILTER (language IS NOT NULL) AS summarized,
  (SELECT count(DISTINCT lower(trim(t))) FROM items, unnest(topics) AS u(t) WHERE trim(t) <> '') AS distinct_topics FROM items"""))
def _(s, d):
    return R.dashboard_summary(items(s, d), F.col("stars") > 100000, F.col("language").isNotNull())


@query(
    "monthly_timeline",
    with_items(
        """, m AS (SELECT *, strftime(starred_at, '%Y-%m') AS month FROM items WHERE starred_at IS NOT NULL),
        r AS (SELECT month, list(full_name ORDER BY rn) AS repos FROM (SELECT month, full_name, row_number() OVER (PARTITION BY month ORDER BY starred_at, item_id) AS rn FROM m) WHERE rn <= 20 GROUP BY month),
        l AS (SELECT month, list(language ORDER BY rn) AS top_languages FROM (SELECT month, language, row_number() OVER (PARTITION BY month ORDER BY count(*) DESC, min(row(starred_at, item_id))) AS rn
          FROM m WHERE language <> '' GROUP BY month, language) WHERE rn <= 3 GROUP BY month),
        t AS (SELECT month, list(topic ORDER BY rn) AS top_topics FROM (SELECT month, topic, row_number() OVER (PARTITION BY month ORDER BY count(*) DESC, min(row(starred_at, item_id, pos))) AS rn
          FROM (SELECT month, starred_at, item_id, unnest(topics) AS topic, generate_subscripts(topics, 1) AS pos FROM m) GROUP BY month, topic) WHERE rn <= 5 GROUP BY month)
        SELECT month, count(*) AS n, any_value(repos) AS repos, coalesce(any_value(top_languages), []) AS top_languages, coalesce(any_value(top_topics), []) AS top_topics
        FROM m LEFT JOIN r USING (month) LEFT JOIN l USING (month) LEFT JOIN t USING (month) GROUP BY month"""
    ).replace("\n, m AS", ", m AS"),
)
def _(s, d):
    return R.monthly_timeline(items(s, d))


@query("language_facets", with_items("SELECT language AS value, count(*) AS n FROM items WHERE language IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10"))
def _(s, d):
    return B.facet(items(s, d), F.col("language"))


@query("tag_facets", with_items("SELECT t AS value, count(*) AS n FROM items, unnest(list_concat(tags, topics)) AS u(t) GROUP BY 1 ORDER BY n DESC, value LIMIT 20"))
def _(s, d):
    return B.facet(items(s, d), F.explode(F.concat("tags", "topics")), limit=20)


@query("cluster_node_counts", with_items("SELECT cluster_id, name, count(*) AS live_count FROM items i JOIN clusters c USING (cluster_id) GROUP BY cluster_id, c.name".replace("cluster_id, name,", "cluster_id, c.name,"), CLUSTERS))
def _(s, d):
    return R.cluster_node_counts(items(s, d), clusters(s, d)).select("cluster_id", "name", "live_count")


@query("refresh_cluster_counts", with_items("SELECT cluster_id, count(*) AS item_count FROM items WHERE cluster_id IN (SELECT cluster_id FROM items WHERE stars > 495000) GROUP BY 1"))
def _(s, d):
    it = items(s, d)
    return R.refreshed_counts(it, it.where("stars > 495000"))


@query(
    "uncategorised_bucket",
    with_items("""SELECT l.list_id, list_name, count(item_id) AS item_count FROM lists l LEFT JOIN items i ON i.list_id = l.list_id GROUP BY ALL
      UNION ALL SELECT -1, 'Uncategorized', count(*) FROM items WHERE list_id IS NULL HAVING count(*) > 0""", LISTS),
)
def _(s, d):
    return R.lists_with_rest(items(s, d), lists(s, d))


@query("list_sizes", with_items("SELECT l.list_id, list_name, count(item_id) AS item_count FROM lists l JOIN items i ON i.list_id = l.list_id GROUP BY ALL ORDER BY item_count DESC, l.list_id LIMIT 10", LISTS))
def _(s, d):
    sizes = R.lists_with_rest(items(s, d), lists(s, d)).where("list_id >= 0 and item_count > 0")
    return sizes.orderBy(F.desc("item_count"), "list_id").limit(10)


@query(
    "recent_activity",
    with_items("""SELECT month, n, rank, (SELECT sum(n) FROM r WHERE rank <= 3) AS recent, (SELECT greatest(max(n), 1) FROM r) AS peak FROM r""",
      "m AS (SELECT strftime(starred_at, '%Y-%m') AS month, count(*) AS n FROM items WHERE starred_at IS NOT NULL GROUP BY 1)",
      "r AS (SELECT * FROM (SELECT month, n, row_number() OVER (ORDER BY month DESC) AS rank FROM m) WHERE rank <= 12)").replace("SELECT month, n, rank, (SELECT sum(n)", "SELECT month, n, rank, (SELECT CAST(sum(n) AS BIGINT)"),
)
def _(s, d):
    return R.recent_activity(items(s, d))


@query("brush_sum", with_items("SELECT CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, row_number() OVER (ORDER BY month) - 1 AS i FROM m) WHERE i BETWEEN 6 AND 18",
  "m AS (SELECT strftime(starred_at, '%Y-%m') AS month, count(*) AS n FROM items WHERE starred_at IS NOT NULL GROUP BY 1)"))
def _(s, d):
    return R.brush_sum(items(s, d), 6, 18)


@query("language_share", with_items("SELECT language AS value, round(100.0 * count(*) / (SELECT count(*) FROM items), 6) AS share FROM items WHERE language IS NOT NULL GROUP BY 1"))
def _(s, d):
    it = items(s, d)
    total = it.agg(F.count("*").alias("total"))
    counted = it.where("language is not null").groupBy(F.col("language").alias("value")).agg(F.count("*").alias("n"))
    return counted.join(total).select("value", F.round(F.when(F.col("total") > 0, 100.0 * F.col("n") / F.col("total")).otherwise(0.0), 6).alias("share"))


@query(
    "windowed_attempts",
    """SELECT event_id, n - 1 AS earlier, n - 1 >= 5 AS blocked FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
      RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM events)""",
)
def _(s, d):
    return R.windowed_attempts(table(s, d, "events"), "user_id", "ts", 86400).select("event_id", "earlier", "blocked")


@query(
    "calendar_columns",
    """SELECT event_id, date_trunc('month', ts) AS month_start, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week_start, dayofweek(ts) IN (0, 6) AS is_weekend,
      CAST(floor(epoch(ts)) AS BIGINT) AS epoch, CAST(event_id * 37 AS BIGINT) AS seconds,
      coalesce(nullif(concat_ws(' ', CASE WHEN event_id * 37 // 86400 > 0 THEN concat(event_id * 37 // 86400, 'd') END, CASE WHEN event_id * 37 // 3600 % 24 > 0 THEN concat(event_id * 37 // 3600 % 24, 'h') END,
        CASE WHEN event_id * 37 // 60 % 60 > 0 THEN concat(event_id * 37 // 60 % 60, 'm') END, CASE WHEN event_id * 37 % 60 > 0 THEN concat(event_id * 37 % 60, 's') END), ''), '0s') AS lasted FROM events""",
)
def _(s, d):
    rows = table(s, d, "events").select("event_id", *(c.alias(k) for k, c in calendar(F.col("ts")).items()), (F.col("event_id") * 37).alias("seconds"))
    return rows.withColumn("lasted", humanized(F.col("seconds")))


@query("flatten_json_props", "SELECT event_id, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def _(s, d):
    return R.flattened_json(table(s, d, "events"), "event_id", "props")
