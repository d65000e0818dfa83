"""Dashboards, facets, timelines and counts over the item table."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfolio.session import broadcast_if_small, cut


def top_values(rows: DataFrame, value: Column, limit: int, *keys: str) -> DataFrame:
    """Most frequent values (for each of ``keys``), names breaking ties."""
    counted = rows.select(*keys, value.alias("value")).where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count("*").alias("n"))
    if not keys:
        return counted.orderBy(F.desc("n"), "value").limit(limit)
    best = W.partitionBy(*keys).orderBy(F.desc("n"), "value")
    return counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def topic_values(items: DataFrame) -> DataFrame:
    """One trimmed, lower-cased topic a row; blank ones dropped."""
    return items.select(F.explode("topics").alias("t")).select(F.lower(F.trim("t")).alias("topic")).where("topic <> ''")


def status_counts(items: DataFrame, embedded: Column, summarized: Column) -> DataFrame:
    return items.agg(F.count("*").alias("total"), F.count_if(embedded).alias("embedded"), F.count_if(summarized).alias("summarized"))


def dashboard_summary(items: DataFrame, embedded: Column, summarized: Column) -> DataFrame:
    """Status counts and the exact number of distinct topics, in one row."""
    topics = topic_values(items).agg(F.countDistinct("topic").alias("distinct_topics"))
    return status_counts(items, embedded, summarized).join(topics)


def monthly_timeline(items: DataFrame, repos: int = 20, languages: int = 3, topics: int = 5) -> DataFrame:
    """Per month of ``starred_at``: count, first names, top languages and topics, ties by first appearance.

    First appearance is by date, then item id, then place in the topics.
    """
    dated = items.where(F.col("starred_at").isNotNull()).withColumn("month", F.date_format("starred_at", "yyyy-MM"))
    counts = dated.groupBy("month").agg(F.count("*").alias("n"))
    place = W.partitionBy("month").orderBy("starred_at", "item_id")
    named = dated.select("month", "full_name", F.row_number().over(place).alias("rank")).where(F.col("rank") <= repos)
    named = _gathered(named, "full_name", "repos")
    langs = dated.where(F.length("language") > 0).select("month", F.col("language").alias("value"), F.struct("starred_at", "item_id", F.lit(0).alias("pos")).alias("seen"))
    tops = dated.select("month", "starred_at", "item_id", F.posexplode("topics").alias("pos", "value"))
    tops = tops.select("month", "value", F.struct("starred_at", "item_id", "pos").alias("seen"))
    out = counts.join(named, "month", "left")
    for rows, limit, name in ((langs, languages, "top_languages"), (tops, topics, "top_topics")):
        out = out.join(_gathered(first_seen_top(rows, limit, "month"), "value", name), "month", "left")
    empty = F.array().cast("array<string>")
    return out.select("month", "n", "repos", F.coalesce("top_languages", empty).alias("top_languages"), F.coalesce("top_topics", empty).alias("top_topics"))


def first_seen_top(rows: DataFrame, limit: int, *keys: str) -> DataFrame:
    """Most frequent ``value`` of each key, ties by the least ``seen``; at most ``limit``, with ``rank``."""
    counted = rows.groupBy(*keys, "value").agg(F.count("*").alias("n"), F.min("seen").alias("seen"))
    best = W.partitionBy(*keys).orderBy(F.desc("n"), "seen")
    return counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def first_seen_top_of_many(rows: DataFrame, limit: int, *keys: str) -> DataFrame:
    """The same for rows by the million: values are counted first, and only where those that can be among the best come first is looked up.

    Counts and numbers are added up in place; the least of structs with names would sort all rows.
    """
    first = F.col("seen").getField(rows.schema["seen"].dataType.fieldNames()[0])
    counted = rows.groupBy(*keys, "value").agg(F.count("*").alias("n"), F.min(first).alias("first"))
    ranked = counted.withColumn("rank", F.rank().over(W.partitionBy(*keys).orderBy(F.desc("n")))).where(F.col("rank") <= limit)
    tops = cut(ranked.drop("rank"))
    names = [*keys, "value"]
    near = broadcast_if_small(tops.select(*(F.col(c).alias(f"top_{c}") for c in names), "first"))
    same = [F.col(c).eqNullSafe(F.col(f"top_{c}")) for c in names]
    met = rows.join(near, reduce(and_, same)).where(first.isNull() | (first == F.col("first")))
    seen = met.groupBy(*names).agg(F.min("seen").alias("seen"))
    seen = seen.select(*(F.col(c).alias(f"top_{c}") for c in names), "seen")
    best = W.partitionBy(*keys).orderBy(F.desc("n"), "seen")
    out = tops.drop("first").join(seen, reduce(and_, same)).select(*names, "n", "seen")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def _gathered(ranked: DataFrame, value: str, name: str, key: str = "month") -> DataFrame:
    """Arrays of a few ranked values a key, in rank order."""
    listed = F.sort_array(F.collect_list(F.struct("rank", F.col(value).alias("v"))))
    return ranked.groupBy(key).agg(F.transform(listed, lambda x: x["v"]).alias(name))


def cluster_node_counts(items: DataFrame, clusters: DataFrame) -> DataFrame:
    live = items.groupBy("cluster_id").agg(F.count("*").alias("live_count"))
    return clusters.join(live, "cluster_id")


def refreshed_counts(items: DataFrame, touched: DataFrame) -> DataFrame:
    """Counts of the clusters that new items went to."""
    ids = touched.select("cluster_id").distinct()
    return items.join(ids, "cluster_id", "left_semi").groupBy("cluster_id").agg(F.count("*").alias("item_count"))


def lists_with_rest(items: DataFrame, lists: DataFrame) -> DataFrame:
    """List sizes, and a row -1 for items in no list if there are any."""
    sizes = items.groupBy("list_id").agg(F.count("*").alias("item_count"))
    named = lists.join(sizes, "list_id", "left").select("list_id", "list_name", F.coalesce("item_count", F.lit(0)).alias("item_count"))
    rest = sizes.where("list_id is null and item_count > 0").select(F.lit(-1).alias("list_id"), F.lit("Uncategorized").alias("list_name"), "item_count")
    return named.unionByName(rest)


def recent_activity(items: DataFrame, series: int = 12, recent: int = 3) -> DataFrame:
    """The last months present, with their rank from the end, the sum of the last few, and the series' peak (1 at least).

    The order is over one row a month.
    """
    months = items.where(F.col("starred_at").isNotNull()).groupBy(F.date_format("starred_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    last = months.withColumn("rank", F.row_number().over(W.orderBy(F.desc("month")))).where(F.col("rank") <= series)
    sums = last.agg(F.sum(F.when(F.col("rank") <= recent, F.col("n"))).alias("recent"), F.greatest(F.max("n"), F.lit(1)).alias("peak"))
    return last.join(sums)


def brush_sum(items: DataFrame, first: int, last: int) -> DataFrame:
    """Items between two 0-based month indexes of the timeline, both included."""
    months = items.where(F.col("starred_at").isNotNull()).groupBy(F.date_format("starred_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    placed = months.withColumn("i", F.row_number().over(W.orderBy("month")) - 1)
    return placed.where(F.col("i").between(first, last)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def windowed_attempts(events: DataFrame, key: str, ts: str, seconds: int = 300, limit: int = 5) -> DataFrame:
    """Earlier attempts of a key in the trailing window (its start included), and whether there were too many.

    All events and both ends of all windows lie in one order, by key and time, that is cut
    into ranges. Each range counts its events apart and carries on from the counts of the
    ranges before it; a window's attempts are the difference of the counts at its ends. So even a single
    key spreads over all tasks. Events without a key share one, and those without a time one moment.
    """
    from kinfolio.session import cut, scratch_table

    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = scratch_table(events.withColumn("_id", F.monotonically_increasing_id()), "attempts")
    # Before the events of the window's first moment, the event itself, after those of its last.
    moments = F.array(*(F.struct((micros - back).alias("t"), F.lit(kind).alias("kind")) for back, kind in ((seconds * 1_000_000, 0), (0, 1), (0, 2))))
    line = rows.select(F.col(key).alias("key"), "_id", F.explode(moments).alias("m")).select("key", "m.t", "m.kind", "_id")
    order = ["key", "t", "kind", "_id"]
    ranged = cut(line.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    event = F.when(F.col("kind") == 1, 1).otherwise(0)
    so_far = F.sum(event).over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    sizes = ranged.groupBy("_range").agg(F.sum(event).alias("_n"))
    carried = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a range
    counted = ranged.withColumn("_so_far", so_far).where("kind <> 1").join(F.broadcast(sizes.select("_range", carried.alias("_carried"))), "_range")
    at = F.col("_so_far") + F.col("_carried")
    found = counted.groupBy("_id").agg((F.sum(F.when(F.col("kind") == 2, at).otherwise(-at)) - 1).alias("earlier"))
    return rows.join(found, "_id").drop("_id").withColumn("blocked", F.col("earlier") >= limit)


def flattened_json(rows: DataFrame, key: str, column: str) -> DataFrame:
    """``key, name, value`` of the non-null fields of a flat JSON object."""
    fields = F.map_entries(F.from_json(column, "map<string,string>"))
    return rows.select(key, F.explode(fields).alias("e")).select(key, F.col("e.key").alias("name"), F.col("e.value").alias("value")).where("value is not null")
