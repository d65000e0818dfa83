"""Queries over sources, sync, snapshots, evaluation, the run ledger and streams."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from kinfolio.functions import numbers as N
from kinfolio.functions import text as T
from kinfolio.operators import evals as E
from kinfolio.operators import ledger as L
from kinfolio.operators import report as R
from kinfolio.operators import snapshot as S
from kinfolio.operators import sync as Y
from kinfolio.plans.base import ITEMS, items, query, table, with_items
from kinfolio.plans.graph import EDGES, _GRAPH, _sql_tag, edges
from kinfolio.session import cut, shared_dir
from kinfolio.sources import landing
from kinfolio.streaming import jobs


def _folder(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _lines(s, d):
    """Star records as JSON lines, made from the items: even ids nested, odd ones bare and without a counter."""
    it = items(s, d)
    repo = F.struct(F.col("item_id").alias("id"), "full_name", "name", F.struct(F.col("language").alias("login")).alias("owner"), "description", "language", "topics", F.col("stars").cast("int").alias("stargazers_count"))
    bare = F.struct(F.col("item_id").alias("id"), "full_name", "name", F.struct(F.col("language").alias("login")).alias("owner"), "description", "language")
    when = F.date_format("starred_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return it.select(F.when(F.col("item_id") % 2 == 0, F.to_json(F.struct(when.alias("starred_at"), repo.alias("repo")))).otherwise(F.to_json(bare)).alias("value"))


@query("normalize_star_payload", with_items("""SELECT item_id, full_name, language AS owner, CASE WHEN item_id % 2 = 0 THEN topics ELSE [] END AS topics,
  CAST(CASE WHEN item_id % 2 = 0 THEN stars ELSE 0 END AS INT) AS stargazers_count, CASE WHEN item_id % 2 = 0 THEN starred_at END AS starred_at FROM items"""))
def _(s, d):
    return landing.star_records(_lines(s, d)).select("item_id", "full_name", "owner", "topics", "stargazers_count", "starred_at")


@query("incremental_cutoff", with_items("SELECT item_id, true AS was_truncated FROM items WHERE starred_at IS NULL OR starred_at > '1999-01-01'"))
def _(s, d):
    return Y.after_cutoff(items(s, d).select("item_id", "starred_at"), "1999-01-01 00:00:00").select("item_id", "was_truncated")


@query("incremental_cutoff_by_date", with_items("""SELECT item_id, (SELECT bool_or(item_id % 5 <> 0 AND starred_at <= TIMESTAMP '1996-06-01') FROM items) AS was_truncated
  FROM items WHERE item_id % 5 = 0 OR starred_at > TIMESTAMP '1996-06-01'"""))
def _(s, d):
    """A cutoff amid the dates, a fifth of which are missing."""
    rows = items(s, d).select("item_id", F.when(F.col("item_id") % 5 != 0, F.col("starred_at")).alias("starred_at"))
    return Y.after_cutoff(rows, "1996-06-01 00:00:00").select("item_id", "was_truncated")


@query("explode_list_members", "SELECT s_nationkey AS list_id, n_regionkey <> 0 AS is_public, s_suppkey AS item_id FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey > 0")
def _(s, d):
    nodes = table(s, d, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.struct(F.col("s_suppkey").alias("databaseId"))).alias("nodes"))
    payload = table(s, d, "nation").join(nodes, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(
        F.col("n_nationkey").alias("list_id"), F.col("n_name").alias("list_name"), (F.col("n_regionkey") == 0).alias("isPrivate"), F.col("n_nationkey").alias("list_order"), F.struct("nodes").alias("items")
    )
    return landing.list_members(payload).select("list_id", "is_public", "item_id")


@query("land_readme", "SELECT doc_id, nullif(left(text, 200), '') AS text FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", landing.landed_text(F.col("text"), 200).alias("text"))


@query("content_hashes", with_items("SELECT item_id, CASE WHEN length(description) > 0 THEN md5(description) ELSE '' END AS description_hash, md5(array_to_string(list_sort(topics), ',')) AS topics_hash FROM items"))
def _(s, d):
    return Y.hashed(items(s, d)).select("item_id", "description_hash", "topics_hash")


@query("embedding_text", with_items("""SELECT item_id, concat_ws(chr(10), full_name, CASE WHEN language IS NOT NULL THEN concat('Language: ', language) END,
  CASE WHEN length(description) > 0 THEN description END, concat('Topics: ', array_to_string(list_filter(topics, lambda t, i: list_position(topics, t) = i), ', '))) AS text FROM items"""))
def _(s, d):
    none = F.lit(None).cast("string")
    out = T.embedding_text(F.col("full_name"), F.col("description"), F.col("topics"), F.col("language"), none, F.lit(None).cast("array<string>"), none)
    return items(s, d).select("item_id", out.alias("text"))


@query("semantic_tags", with_items("""SELECT item_id, [lower(replace(b, '#', '-')), b] AS tags FROM (SELECT item_id, tags[1] AS b FROM items)"""))
def _(s, d):
    from kinfolio.functions.tags import semantic_tags

    return items(s, d).select("item_id", semantic_tags(F.slice("tags", 1, 1)).alias("tags"))


_BOTH = f"flatten(list_transform(tags, lambda t: [{_sql_tag('t')}, trim(t)]))"


@query("semantic_tags_whole", f"""WITH {ITEMS}, twice AS (SELECT item_id, list_concat(tags, list_transform(tags, lambda t: upper(t)), ['', ' x ']) AS tags FROM items),
  forms AS (SELECT item_id, list_filter({_BOTH}, lambda t: t <> '') AS forms FROM twice)
  SELECT item_id, list_filter(forms, lambda t, i: list_position(list_transform(forms, lambda x: lower(x)), lower(t)) = i) AS tags FROM forms""")
def _(s, d):
    """All tags, each again in upper case: distinct without regard to case."""
    from kinfolio.functions.tags import semantic_tags

    twice = F.concat("tags", F.transform("tags", F.upper), F.array(F.lit(""), F.lit(" x ")))
    return items(s, d).select("item_id", semantic_tags(twice).alias("tags"))


READMES = r"""WITH cleaned AS (SELECT doc_id, list_transform(string_split(regexp_replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '^\s+|\s+$', '', 'g'), chr(10)),
    lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS lines FROM documents),
  cutting AS (SELECT doc_id, string_split(replace(array_to_string(list_filter(lines, lambda x: x <> ''), chr(10)), chr(10) || '#', chr(10) || chr(1) || '#'), chr(10) || chr(1)) AS blocks FROM cleaned),
  blocks AS (SELECT doc_id, unnest(blocks) AS block, generate_subscripts(blocks, 1) AS k FROM cutting),
  parts AS (SELECT doc_id, k, CASE WHEN starts_with(block, '#') THEN lower(trim(regexp_extract(block, '^#+([^\n]*)', 1))) ELSE '' END AS heading,
    regexp_extract_all(regexp_replace(block, '^#[^\n]*\n?', '') || chr(10), '(?s).{401,}?\n|.+') AS found FROM blocks),
  titled AS (SELECT doc_id, k, list_transform(list_filter(found, lambda x: x <> chr(10)),
    lambda x: CASE WHEN heading <> '' THEN heading || ': ' ELSE '' END || replace(rtrim(x, chr(10)), chr(10), ' ')) AS titled FROM parts),
  listed AS (SELECT doc_id, flatten(list(titled ORDER BY k)) AS listed FROM titled GROUP BY doc_id),
  chosen AS (SELECT doc_id, listed, list_filter(listed, lambda x: regexp_matches(lower(x), 'WORDS')) AS useful FROM listed)
SELECT doc_id, substring(CASE WHEN len(listed) = 0 THEN array_to_string(lines[1:40], ' ') WHEN len(useful) > 0 THEN array_to_string(useful, ' | ')
  ELSE array_to_string(listed[1:3], ' | ') END, 1, 1200) AS signal
FROM cleaned JOIN chosen USING (doc_id)""".replace("WORDS", "|".join(T.SIGNAL_WORDS))


@query("readme_signal", READMES)
def _(s, d):
    return table(s, d, "documents").select("doc_id", T.readme_signal(F.col("text")).alias("signal"))


@query("embed_plugged", "SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[^\\s]') THEN [CAST(length(text) AS DOUBLE), CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE)] ELSE [CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)] END AS embedding FROM documents")
def _(s, d):
    """The plug point: vectors come from a callable over batches of texts."""
    from kinfolio.operators.embed import embed

    def measure(texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(t.count("e"))] for t in texts]

    return embed(table(s, d, "documents"), "doc_id", "text", measure, 2)


@query("embed_items")
def _(s, d):
    from kinfolio.operators.embed import embed_hashing

    return embed_hashing(table(s, d, "documents"), "doc_id", "text", 64).select("doc_id", F.size("embedding").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"))


@query("parse_cluster_reply", """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN concat('Topic ', conv_id) ELSE 'Plain line' END AS name,
  CASE WHEN turn % 2 = 0 THEN role ELSE concat('Contains ', turn, ' related repositories') END AS description,
  CASE WHEN turn % 2 = 0 THEN ['a', 'b', CAST(turn AS VARCHAR)] ELSE [role] END AS keywords FROM conversations""")
def _(s, d):
    rows = table(s, d, "conversations")
    reply = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("\n Topic "), F.col("conv_id").cast("string"), F.lit(" |"), F.col("role"), F.lit("| a, ,b ,"), F.col("turn").cast("string"), F.lit("\nmore"))).otherwise(F.lit(" Plain   line \nrest"))
    parsed = T.parse_cluster_reply(reply, F.col("turn"), F.array("role"))
    return rows.select("conv_id", "turn", parsed.alias("p")).select("conv_id", "turn", "p.name", "p.description", "p.keywords")


@query("parse_enrichment_reply", """SELECT conv_id, turn, trim(role) AS summary, [role, 'x'] AS tags FROM conversations""")
def _(s, d):
    rows = table(s, d, "conversations")
    good = F.to_json(F.struct(F.col("role").alias("summary"), F.array(F.col("role"), F.lit("x"), F.lit("much too long to be a tag")).alias("tags")))
    fenced = F.concat(F.lit("```json\n"), good, F.lit("\n```"))
    broken = F.concat(F.lit('{"summary": "'), F.col("role"), F.lit('", "tags": ["'), F.col("role"), F.lit("\", 'x'] oops"))
    reply = F.when(F.col("turn") % 3 == 0, good).when(F.col("turn") % 3 == 1, fenced).otherwise(broken)
    return rows.select("conv_id", "turn", T.parse_enrichment_reply(reply).alias("p")).select("conv_id", "turn", "p.summary", "p.tags")


@query("repair_reply", """SELECT conv_id, turn, CASE turn % 7 WHEN 5 THEN 'see { } [ ]' ELSE concat('the ', role, ' "x"') END AS summary, CASE turn % 7 WHEN 1 THEN ['a'] ELSE ['a', role] END AS tags FROM conversations""")
def _(s, d):
    """Replies damaged in seven ways."""
    rows = table(s, d, "conversations")
    quoted = F.concat(F.lit("the "), "role", F.lit(r' \"x\"'))
    first = F.concat(F.lit('{"summary": "'), quoted, F.lit('"'))
    tags = F.concat(F.lit(', "tags": ["a", "'), "role")
    damaged = (
        F.when(F.col("turn") % 7 == 0, F.concat(first, tags, F.lit('"],}')))
        .when(F.col("turn") % 7 == 1, F.concat(first, F.lit(', "tags": ["a"')))
        .when(F.col("turn") % 7 == 2, F.concat(first, tags))
        .when(F.col("turn") % 7 == 3, F.concat(F.lit("Here it is: {'summary': 'the "), "role", F.lit(""" "x"', 'tags': ['a', '"""), "role", F.lit("']} and more")))
        .when(F.col("turn") % 7 == 4, F.concat(first, F.lit(' tags: [a "'), "role", F.lit('"')))
        .when(F.col("turn") % 7 == 5, F.concat(F.lit('{"summary": "see { } [ ]", "tags": ["a", "'), "role", F.lit('"}')))
        .otherwise(F.concat(first, F.lit(', "rest": {"deep": [1, {"k": "v"'), F.lit('}], "tags": 3}'), tags, F.lit('"]')))
    )
    return rows.select("conv_id", "turn", T.parse_enrichment_reply(damaged).alias("p")).select("conv_id", "turn", "p.summary", "p.tags")


@query("fallback_tags", with_items("""SELECT item_id, CASE WHEN item_id % 3 = 0 THEN tags WHEN item_id % 3 = 1 THEN topics WHEN language IS NOT NULL THEN [language, 'open-source']
  ELSE [string_split(name, ' ')[1], 'open-source'] END AS tags FROM items"""))
def _(s, d):
    kept = F.when(F.col("item_id") % 3 == 0, F.col("tags"))
    topics = F.when(F.col("item_id") % 3 == 1, F.col("topics"))
    return items(s, d).select("item_id", T.fallback_tags(kept, topics, F.col("language"), F.col("full_name")).alias("tags"))


def _stored(s, d):
    """Stored items: two thirds of all, some with an old description or topics."""
    rows = items(s, d).where("item_id % 3 <> 0").select("item_id", "full_name", "language", "stars", "topics", "tags", F.col("embedding"), "description")
    old = rows.withColumn("description", F.when(F.col("item_id") % 5 == 0, F.lit("old text")).otherwise(F.col("description")))
    return Y.hashed(old.withColumn("stars", F.lit(1).cast("long")))


def _incoming(s, d):
    return items(s, d).where("item_id % 7 <> 0").select("item_id", "full_name", "language", "stars", "topics", "description")


STATES = """states AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'new' WHEN item_id % 5 = 0 AND description <> 'old text' THEN 'changed' ELSE 'unchanged' END AS state FROM items WHERE item_id % 7 <> 0)"""


@query("classify_changes", with_items("SELECT item_id, state FROM states", STATES))
def _(s, d):
    return Y.classify(_incoming(s, d), _stored(s, d))


@query("match_existing", with_items("SELECT item_id, item_id % 3 <> 0 AS known FROM items WHERE item_id % 7 <> 0"))
def _(s, d):
    old = _stored(s, d).select("item_id", F.lit(True).alias("known"))
    return _incoming(s, d).join(old, "item_id", "left").select("item_id", F.coalesce("known", F.lit(False)).alias("known"))


@query(
    "upsert_items",
    with_items("""SELECT i.item_id, CASE WHEN state IS NULL THEN 1 ELSE stars END AS stars, CASE WHEN state IS NULL AND i.item_id % 5 = 0 THEN md5('old text') ELSE md5(description) END AS description_hash,
      coalesce(state, '') NOT IN ('new', 'changed') AS embedded FROM items i LEFT JOIN states USING (item_id) WHERE state IS NOT NULL OR i.item_id % 3 <> 0""", STATES),
)
def _(s, d):
    return Y.upsert(_incoming(s, d), _stored(s, d)).select("item_id", "stars", "description_hash", F.col("embedding").isNotNull().alias("embedded"))


@query("sync_items", with_items("""SELECT count(*) FILTER (state = 'new') AS new, count(*) FILTER (state = 'changed') AS changed, count(*) FILTER (state = 'unchanged') AS unchanged,
  (SELECT count(*) FROM items WHERE item_id % 3 <> 0 AND item_id % 7 = 0) AS removed FROM states""", STATES))
def _(s, d):
    return Y.sync(_incoming(s, d), _stored(s, d))[1]


@query("delete_missing", with_items("SELECT item_id FROM items WHERE item_id % 3 <> 0 AND item_id % 7 <> 0"))
def _(s, d):
    return Y.delete_missing(_stored(s, d), _incoming(s, d)).select("item_id")


@query("removed_items", with_items("SELECT item_id FROM items WHERE item_id % 3 <> 0 AND item_id % 7 = 0"))
def _(s, d):
    return Y.removed(_stored(s, d), _incoming(s, d))


@query("assign_lists", with_items("""SELECT item_id, CAST(coalesce(l, list_id) AS BIGINT) AS list_id FROM items LEFT JOIN (SELECT l_partkey AS item_id, arg_max(l_suppkey, l_orderkey * 10 + l_linenumber) AS l FROM lineitem
  WHERE l_quantity > 45 GROUP BY 1) USING (item_id)"""))
def _(s, d):
    members = table(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("list_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("list_order"))
    return Y.assign_lists(items(s, d).withColumn("list_id", F.col("list_id").cast("long")), members).select("item_id", "list_id")


@query("reset_items", with_items("SELECT item_id, NULL::INT AS cluster_id, name FROM items"))
def _(s, d):
    return Y.reset(items(s, d), "cluster_id", "embedding").select("item_id", "cluster_id", "name")


@query("upsert_feedback", """SELECT user_id, anchor, candidate, verdict FROM (SELECT user_id, event_id % 40 AS anchor, event_id % 31 AS candidate, event_type AS verdict,
  row_number() OVER (PARTITION BY user_id, event_id % 40, event_id % 31 ORDER BY ts DESC, event_type DESC) AS rn FROM events WHERE event_id % 40 IN (SELECT vec_id FROM embeddings) AND event_id % 31 IN (SELECT vec_id FROM embeddings)) WHERE rn = 1""")
def _(s, d):
    rows = table(s, d, "events").select("user_id", (F.col("event_id") % 40).alias("anchor"), (F.col("event_id") % 31).alias("candidate"), F.col("event_type").alias("verdict"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    old, new = rows.where("event_id % 2 = 0").drop("event_id"), rows.where("event_id % 2 = 1").drop("event_id")
    ids = table(s, d, "embeddings").select(F.col("vec_id").alias("item_id"))
    # Stored feedback was checked when it came in.
    old = old.join(ids.withColumnRenamed("item_id", "anchor"), "anchor", "left_semi").join(ids.withColumnRenamed("item_id", "candidate"), "candidate", "left_semi").select("user_id", "anchor", "candidate", "verdict", "ts")
    return Y.upsert_feedback(old, new.select("user_id", "anchor", "candidate", "verdict", "ts"), ids).select("user_id", "anchor", "candidate", "verdict")


@query("stale_anchors", with_items("SELECT item_id FROM items WHERE item_id % 4 = 0 OR item_id % 4 = 1"))
def _(s, d):
    now = items(s, d).select("item_id", F.col("starred_at").alias("updated_at"), F.lit("2024-01-01").cast("timestamp").alias("synced_at"))
    cached = now.where("item_id % 4 <> 0").select("item_id", F.when(F.col("item_id") % 4 == 1, F.lit("1990-01-01").cast("timestamp")).otherwise(F.col("updated_at")).alias("anchor_updated_at"), "synced_at")
    return Y.stale_anchors(now, cached)


@query("rehydrate_related", with_items("""SELECT c.item_id, c.target, i.name, row_number() OVER (PARTITION BY c.item_id ORDER BY pos) AS rank FROM (SELECT o_custkey AS item_id, unnest(ids) AS target, generate_subscripts(ids, 1) AS pos
  FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1)) c JOIN items i ON i.item_id = c.target QUALIFY rank <= 20"""))
def _(s, d):
    cached = table(s, d, "orders").groupBy(F.col("o_custkey").alias("item_id")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("related"))
    return Y.rehydrate(cached, items(s, d).select("item_id", "name")).select("item_id", "target", "name", "rank")


def _payload(s, d):
    it = items(s, d)
    nodes = it.where("stars > 50000").select("item_id", "full_name", "name", F.concat(F.lit("https://example.org/"), F.col("item_id").cast("string")).alias("html_url"), "cluster_id")
    timeline = R.monthly_timeline(it).select("month", "n")
    # Cut off here: versions share the edges, and totals count them, too.
    return nodes, cut(edges(s, d)), timeline


@query("snapshot_roundtrip", with_items("SELECT item_id, name FROM items WHERE stars > 50000"))
def _(s, d):
    root, (nodes, links, timeline) = _folder(s, "snapshots"), _payload(s, d)
    S.publish(s, root, 1, "v1", nodes, links, timeline)
    S.publish(s, root, 1, "v2", nodes.where("item_id % 2 = 0"), links, timeline)
    S.rollback(s, root, 1)
    return S.read(s, root, "nodes", 1, S.resolve(s, root, 1)).select("item_id", "name")


@query("snapshot_timeline", with_items("SELECT strftime(starred_at, '%Y-%m') AS month, count(*) AS n FROM items GROUP BY 1"))
def _(s, d):
    root, (nodes, links, timeline) = _folder(s, "snapshots"), _payload(s, d)
    S.publish(s, root, 7, "v1", nodes, links, timeline)
    return S.read(s, root, "timeline", 7, S.resolve(s, root, 7))


@query("snapshot_metadata", with_items("""SELECT (SELECT count(*) FROM items WHERE stars > 50000) AS total_nodes, (SELECT count(*) FROM edges) AS total_edges,
  (SELECT count(DISTINCT strftime(starred_at, '%Y-%m')) FROM items) AS timeline_points""", *_GRAPH, EDGES))
def _(s, d):
    return S.meta(*_payload(s, d))


@query("snapshot_consistency", with_items("SELECT false AS valid, 'node_count_mismatch' AS reason FROM items LIMIT 1"))
def _(s, d):
    nodes, links, timeline = _payload(s, d)
    return S.consistency(nodes.where("item_id % 2 = 0"), links, timeline, S.meta(nodes, links, timeline))


@query("snapshot_outcomes", with_items("""SELECT c AS name, c = 'sound' AS valid, CASE c WHEN 'sound' THEN 'ok' WHEN 'nodes' THEN 'node_count_mismatch' WHEN 'edges' THEN 'edge_count_mismatch'
  WHEN 'timeline' THEN 'timeline_missing' ELSE 'required_fields_missing' END AS reason FROM (SELECT unnest(['sound', 'nodes', 'edges', 'timeline', 'fields']) AS c) WHERE (SELECT count(*) FROM items) > 0"""))
def _(s, d):
    """All five outcomes of the check; the first fault found is named."""
    nodes, links, timeline = _payload(s, d)
    nodes, timeline = cut(nodes), cut(timeline)
    declared = cut(S.meta(nodes, links, timeline))
    bare = nodes.withColumn("html_url", F.when(F.col("item_id") % 2 == 0, F.col("html_url")))
    cases = {
        "sound": (nodes, links, timeline),
        "nodes": (nodes.where("item_id % 2 = 0"), links.limit(0), timeline),
        "edges": (bare, links.where("source % 2 = 0"), timeline),
        "timeline": (bare, links, timeline.limit(0)),
        "fields": (bare, links, timeline),
    }
    found = [S.consistency(*parts, declared).withColumn("name", F.lit(name)) for name, parts in cases.items()]
    return reduce(lambda a, b: a.unionByName(b), found).select("name", "valid", "reason")


@query("snapshot_edges", with_items("SELECT source, target, edge_index FROM indexed", *_GRAPH, EDGES))
def _(s, d):
    """Edges of the active version, read back in index order."""
    from kinfolio.operators.graph import indexed

    root, (nodes, links, timeline) = _folder(s, "snapshots"), _payload(s, d)
    S.publish(s, root, 3, "v1", nodes, indexed(links), timeline)
    return S.hydrate(s, root, 3)[1].select("source", "target", "edge_index")


@query("snapshot_version", with_items("SELECT concat('snapshot-', strftime(max(starred_at), '%Y%m%d%H%M%S'), '-n', count(*), '-e', count(*) FILTER (stars > 100)) AS version FROM items"))
def _(s, d):
    row = items(s, d).agg(F.date_format(F.max("starred_at"), "yyyyMMddHHmmss").alias("t"), F.count("*").alias("n"), F.count_if(F.col("stars") > 100).alias("e"))
    return row.select(F.format_string("snapshot-%s-n%d-e%d", "t", "n", "e").alias("version"))


GOLD = """gold AS (SELECT vec_id AS anchor, label FROM embeddings WHERE vec_id % 5 = 0),
pos AS (SELECT g.anchor, list(e.vec_id) AS positives FROM gold g JOIN embeddings e ON e.label = g.label AND e.vec_id BETWEEN g.anchor + 1 AND g.anchor + 20 GROUP BY 1),
pred AS (SELECT vec_id AS anchor, [vec_id + 1, vec_id + 2, vec_id + 3, vec_id + 4, vec_id + 5, vec_id + 6] AS predicted FROM embeddings WHERE vec_id % 15 <> 0),
scored AS (SELECT p.anchor, predicted IS NOT NULL AS covered, coalesce(len(list_filter(predicted[1:5], lambda x: list_contains(positives, x))), 0) / 5 AS prec,
  coalesce(list_sum(list_transform(predicted[1:5], lambda x, i: CASE WHEN list_contains(positives, x) THEN 1 / log2(i + 1) ELSE 0 END)), 0)
    / list_sum(list_transform(range(1, least(len(positives), 5) + 1), lambda i: 1 / log2(i + 1))) AS ndcg FROM pos p LEFT JOIN pred USING (anchor))"""


def _goldset(s, d):
    e = table(s, d, "embeddings").select("vec_id", "label")
    # A judged set lists a bounded number of items an anchor: of the next 20, those with its label.
    near = e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("anchor"), F.col("label").alias("l"), F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 20)).alias("vec_id"))
    gold = near.join(e, "vec_id").where(F.col("label") == F.col("l")).groupBy("anchor").agg(F.collect_list("vec_id").alias("positives"))
    pred = e.where("vec_id % 15 <> 0").select(F.col("vec_id").alias("anchor"), F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.col("vec_id") + i).alias("predicted"))
    return gold, pred


@query("ranking_metrics", f"WITH {GOLD} SELECT anchor, prec AS precision, round(ndcg, 6) AS ndcg, covered FROM scored")
def _(s, d):
    return E.ranking(*_goldset(s, d)).select("anchor", "precision", F.round("ndcg", 6).alias("ndcg"), "covered")


@query("ranking_summary", f"WITH {GOLD} SELECT count(*) AS anchors, round(avg(prec), 6) AS precision_at_k, round(avg(ndcg), 6) AS ndcg_at_k, round(avg(CAST(covered AS INT)), 6) AS coverage FROM scored")
def _(s, d):
    out = E.ranking_summary(*_goldset(s, d))
    return out.select("anchors", *(F.round(c, 6).alias(c) for c in ("precision_at_k", "ndcg_at_k", "coverage")))


_PUR = "r AS (SELECT item_id, CASE WHEN item_id % 9 = 0 THEN -1 ELSE cluster_id // 2 END AS c, cluster_id AS label FROM items)"


@query("purity", with_items("""SELECT round((SELECT sum(b) FROM (SELECT max(n) AS b FROM (SELECT c, label, count(*) AS n FROM r WHERE c <> -1 GROUP BY 1, 2) GROUP BY c)) / count(*) FILTER (c <> -1), 6) AS purity,
  round(count(*) FILTER (c <> -1) / count(*), 6) AS coverage FROM r""", _PUR))
def _(s, d):
    rows = items(s, d).select("item_id", F.when(F.col("item_id") % 9 == 0, -1).otherwise(F.floor(F.col("cluster_id") / 2)).alias("cluster_id"), F.col("cluster_id").alias("label"))
    return E.purity(rows).select(F.round("purity", 6).alias("purity"), F.round("coverage", 6).alias("coverage"))


@query("quality_gate", f"WITH {GOLD} SELECT false AS passed, list_filter([CASE WHEN avg(prec) < 0.8 THEN 'precision_at_k' END, CASE WHEN avg(CAST(covered AS INT)) < 0.95 THEN 'coverage' END], lambda x: x IS NOT NULL) AS failed FROM scored")
def _(s, d):
    return E.gates(E.ranking_summary(*_goldset(s, d)))


@query("read_goldset", f"WITH {GOLD} SELECT anchor, CAST(len(positives) AS INT) AS n FROM pos")
def _(s, d):
    path = _folder(s, "goldset")
    gold, _pred = _goldset(s, d)
    gold.select(F.col("anchor").alias("anchor_repo_id"), F.col("positives").alias("positive_ids")).write.json(path)
    return landing.read_goldset(s, path).select(F.col("anchor_repo_id").alias("anchor"), F.size("positive_ids").alias("n"))


@query("read_predictions", f"WITH {GOLD} SELECT anchor, CAST(generate_subscripts(predicted, 1) - 1 AS INT) AS pos, unnest(predicted) AS predicted FROM pred")
def _(s, d):
    pred = _goldset(s, d)[1]
    text = pred.select(F.to_json(F.map_from_arrays(F.array(F.col("anchor").cast("string")), F.array("predicted"))).alias("value"))
    return landing.predictions(text)


@query("quality_report", f"WITH {GOLD} SELECT count(*) AS anchors FROM scored")
def _(s, d):
    path = _folder(s, "report")
    landing.write_report(E.ranking_summary(*_goldset(s, d)), path)
    return s.read.schema("anchors long").json(path)


@query("quality_report_metrics", f"WITH {GOLD} SELECT count(*) AS anchors, round(avg(prec), 6) AS precision_at_k, round(avg(ndcg), 6) AS ndcg_at_k, round(avg(CAST(covered AS INT)), 6) AS coverage FROM scored")
def _(s, d):
    """All metrics of the report, as they are in the file."""
    path = _folder(s, "report")
    landing.write_report(E.ranking_summary(*_goldset(s, d)), path)
    found = s.read.schema("anchors long, precision_at_k double, ndcg_at_k double, coverage double").json(path)
    return found.select("anchors", *(F.round(c, 6).alias(c) for c in ("precision_at_k", "ndcg_at_k", "coverage")))


def _steps(s, d):
    """Order lines stand for the steps of runs: returned ones failed in part, a few altogether."""
    li = table(s, d, "lineitem")
    failed = F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("long")).otherwise(0)
    status = F.when((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 49), "failed").otherwise("completed")
    message = F.when(failed > 40, F.concat(F.lit("step "), F.col("l_linenumber").cast("string")))
    return li.select(F.col("l_orderkey").alias("run_id"), F.col("l_shipdate"), F.col("l_partkey").cast("string").alias("step"), F.col("l_linenumber").alias("position"), status.alias("status"), failed.alias("failed_items"), message.alias("message"))


STEPS = """steps AS (SELECT l_orderkey AS run_id, l_partkey AS step, l_linenumber AS position, CASE WHEN l_returnflag = 'A' AND l_quantity > 49 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS failed_items, CASE WHEN l_returnflag = 'R' AND l_quantity > 40 THEN concat('step ', l_linenumber) END AS message FROM lineitem)"""


@query("pipeline_outcome", f"""WITH {STEPS} SELECT run_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN sum(failed_items) > 0 THEN 'partial_failed' ELSE 'completed' END AS status,
  CAST(sum(failed_items) AS BIGINT) AS failed_items, coalesce(string_agg(message, '; ' ORDER BY position, message), '') AS messages FROM steps GROUP BY 1""")
def _(s, d):
    return L.outcome(_steps(s, d))


@query("full_refresh_report", f"WITH {STEPS} SELECT run_id, CAST(count(*) AS INT) AS n FROM steps WHERE status = 'completed' AND failed_items > 0 GROUP BY 1")
def _(s, d):
    return L.refresh_report(_steps(s, d)).select("run_id", F.size("partial").alias("n"))


@query("refresh_report_parts", f"WITH {STEPS} SELECT run_id, position, CAST(step AS VARCHAR) AS step, failed_items FROM steps WHERE status = 'completed' AND failed_items > 0")
def _(s, d):
    """Every part of the report."""
    return L.refresh_report(_steps(s, d)).select("run_id", F.explode("partial").alias("p")).select("run_id", "p.position", "p.step", "p.failed_items")


@query("latest_run", "SELECT o_custkey AS user_id, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) AS run_id FROM orders GROUP BY 1")
def _(s, d):
    return L.latest_run(_runs(s, d))


@query("active_run", "SELECT o_custkey AS user_id, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) AS run_id FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def _(s, d):
    return L.active_run(_runs(s, d))


def _runs(s, d):
    status = F.when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
    return table(s, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"), status.alias("status"))


@query("run_progress", """SELECT o_orderkey AS run_id, round(least(100, o_custkey / 10.0), 6) AS percent, CASE WHEN o_orderstatus = 'F' THEN 'failed' WHEN o_orderstatus = 'O' THEN 'completed' ELSE 'sync' END AS phase,
  CASE WHEN o_custkey > 0 AND o_custkey < 1000 AND floor(greatest(60.0 * (100.0 / (o_custkey / 1000 * 100.0)) - 60.0, 0)) > 0 THEN CAST(floor(60.0 * (100.0 / (o_custkey / 1000 * 100.0)) - 60.0) AS BIGINT) END AS eta FROM orders""")
def _(s, d):
    percent = N.progress_percent(F.lit(1000), F.col("o_custkey"))
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "completed").otherwise("running")
    return table(s, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.round(percent, 6).alias("percent"), N.job_phase(F.lit("sync"), status, F.lit("")).alias("phase"), N.eta_seconds(F.lit(60.0), percent).alias("eta"))


@query("cache_key", "SELECT l_orderkey, l_linenumber, printf('related-v1|ms=%.4f|sem=%.4f|limit=%d', l_discount, l_tax, l_linenumber) AS key FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", N.cache_key(F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber")).alias("key"))


@query("stream_attempts", """SELECT user_id, w AS start, count(*) AS n FROM (SELECT user_id, unnest(generate_series(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 18 HOUR, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), INTERVAL 6 HOUR)) AS w FROM events)
  GROUP BY 1, 2""")
def _(s, d):
    target, checkpoint = _folder(s, "attempts"), _folder(s, "attempts-checkpoint")
    # A stream reads folders: the table goes into one first, as events would land.
    landed = _folder(s, "events")
    table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id").write.parquet(landed)
    schema, windows = "event_id long, ts timestamp, user_id long", ("user_id", "ts", "24 hours", "6 hours")
    jobs.run_attempts(s, landed, schema, target, checkpoint, *windows)
    return jobs.attempts_now(s, landed, schema, target, *windows).select("user_id", F.col("window.start").alias("start"), "n")


@query("stream_sync", with_items("SELECT item_id, full_name, CAST(CASE WHEN item_id % 2 = 0 THEN stars ELSE 0 END AS INT) AS stars FROM items"))
def _(s, d):
    landed, root, checkpoint = _folder(s, "records"), _folder(s, "stream"), _folder(s, "stream-checkpoint")
    _lines(s, d).write.text(landed)
    jobs.stream_sync(s, landed, root, checkpoint)
    return jobs.current_table(s, root).select("item_id", "full_name", "stars")
