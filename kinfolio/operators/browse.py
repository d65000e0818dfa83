"""Filters, search, sorting and paging over an item table.

Items have ``item_id, full_name, name, description, language, topics, tags, list_id,
cluster_id, stars, starred_at``. Null languages, lists and clusters fail their filters.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SORT_FIELDS = ("starred_at", "stars", "name", "full_name", "language", "item_id", "cluster_id")
UNCATEGORIZED = "Uncategorized"
NO_LIST = -1


def in_clusters(cluster_ids: list[int] | None = None, cluster_id: int | None = None) -> Column:
    """A list of ids wins over a single id; neither filters nothing."""
    if cluster_ids:
        return F.col("cluster_id").isin(cluster_ids)
    return F.col("cluster_id") == cluster_id if cluster_id is not None else F.lit(True)


def in_language(language: str | None) -> Column:
    return F.col("language") == language if language else F.lit(True)


def min_stars(least: int | None) -> Column:
    return F.col("stars") >= least if least and least > 0 else F.lit(True)


def stars_threshold(q: str) -> int | None:
    """N of a query ``stars:>N``, in any case and with spaces; else None."""
    found = re.fullmatch(r"\s*stars\s*:\s*>\s*(\d+)\s*", q or "", re.IGNORECASE)
    return int(found[1]) if found else None


def matches(q: str, literal: bool = False) -> Column:
    """Case-insensitive search over the text columns, tags and topics; ``stars:>N`` compares stars instead.

    ``%`` and ``_`` are wildcards unless ``literal``. Arrays are searched in their text form ``{a,b}``.
    """
    threshold = stars_threshold(q)
    if threshold is not None:
        return F.col("stars") > threshold
    if not (q or "").strip():
        return F.lit(True)
    as_text = lambda c: F.concat(F.lit("{"), F.array_join(c, ","), F.lit("}"))
    fields = [F.col(c) for c in ("name", "full_name", "description", "language")] + [as_text("tags"), as_text("topics")]
    hit = F.lit(False)
    for field in fields:
        found = F.lower(field).contains(q.lower()) if literal else field.ilike(f"%{q}%")
        hit = hit | F.coalesce(found, F.lit(False))
    return hit


def month_bounds(month: str) -> tuple[datetime, datetime]:
    """[start, next) of ``YYYY-MM`` in UTC; anything else is an error."""
    found = re.fullmatch(r"(\d{4})-(0[1-9]|1[0-2])", month)
    if not found:
        raise ValueError(f"month must be YYYY-MM, not {month!r}")
    year, n = int(found[1]), int(found[2])
    return datetime(year, n, 1), datetime(year + n // 12, n % 12 + 1, 1)


def in_month(month: str, ts: str = "starred_at") -> Column:
    start, stop = (F.lit(x.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp") for x in month_bounds(month))
    return (F.col(ts) >= start) & (F.col(ts) < stop)


def has_topic(topic: str) -> Column:
    wanted = topic.strip().lower()
    return F.exists("topics", lambda t: F.lower(F.trim(t)) == wanted)


def ordered(df: DataFrame, field: str = "starred_at", descending: bool = True) -> DataFrame:
    """Sort by a known field (else ``starred_at``), nulls first when descending and last when ascending, ids breaking ties."""
    name = field if field in SORT_FIELDS else "starred_at"
    keys = [F.col(name).desc_nulls_first(), F.col("item_id").desc()] if descending else [F.col(name).asc_nulls_last(), F.col("item_id").asc()]
    return df.orderBy(*keys)


def page(df: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of a sorted frame, of 1 to 2000 rows."""
    if not 1 <= limit <= 2000 or offset < 0:
        raise ValueError("limit must be 1 to 2000 and offset not negative")
    return df.offset(offset).limit(limit)


def browse(items: DataFrame, *conditions: Column, sort: str = "starred_at", descending: bool = True, limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of the items that meet all conditions, with the filtered and the total count in each row."""
    keep = F.lit(True)
    for c in conditions:
        keep = keep & c
    counts = items.agg(F.count_if(keep).alias("filtered_count"), F.count("*").alias("total_count"))
    rows = page(ordered(items.where(keep), sort, descending), limit, offset)
    return rows.join(F.broadcast(counts))


def list_page(items: DataFrame, *conditions: Column, sort: str = "starred_at", descending: bool = True, number: int = 1, per_page: int = 30) -> DataFrame:
    """1-based pages of at most 100 rows, with ``has_more`` in each row."""
    per_page = max(1, min(per_page, 100))
    start = (max(number, 1) - 1) * per_page
    rows = browse(items, *conditions, sort=sort, descending=descending, limit=per_page, offset=start)
    return rows.withColumn("has_more", F.col("filtered_count") > start + per_page)


def visible_nodes(items: DataFrame, clusters: list[int] | None = None, lists: list[int] | None = None, languages: list[str] | None = None, least: int = 0, q: str = "", months: tuple[str, str] | None = None) -> DataFrame:
    """Nodes that pass all set filters; a node without a date passes the month range."""
    keep = matches(q, literal=True) & (F.col("stars") >= least)
    for name, values in (("cluster_id", clusters), ("list_id", lists), ("language", languages)):
        if values:
            keep = keep & F.coalesce(F.col(name).isin(values), F.lit(False))
    if months:
        month = F.date_format("starred_at", "yyyy-MM")
        keep = keep & F.coalesce(month.between(*months), F.lit(True))
    return items.where(keep)


def match_clusters(clusters: DataFrame, q: str) -> DataFrame:
    """Clusters whose name, description or a keyword contains the query."""
    wanted = q.strip().lower()
    texts = F.concat(F.array("name", "description"), F.coalesce("keywords", F.array().cast("array<string>")))
    return clusters.where(F.exists(texts, lambda t: F.coalesce(F.lower(t).contains(wanted), F.lit(False))))


def facet(items: DataFrame, value: Column, q: str = "", limit: int = 10) -> DataFrame:
    """Values of a column or exploded array with their counts, most frequent first, names breaking ties."""
    rows = items.select(value.alias("value")).where(F.col("value").isNotNull() & F.lower("value").contains(q.lower()))
    return rows.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def pending(items: DataFrame) -> DataFrame:
    """Items without a vector, and whether a summary or tags are missing too."""
    rows = items.where(F.col("embedding").isNull())
    return rows.withColumn("needs_enrichment", F.col("summary").isNull() | (F.coalesce(F.size("tags"), F.lit(0)) <= 0))


def drop_unembedded_layout(items: DataFrame, *columns: str) -> DataFrame:
    """Items without a vector lose their cluster and coordinates."""
    return items.withColumns({c: F.when(F.col("embedding").isNotNull(), F.col(c)) for c in columns})


def join_lists(items: DataFrame, lists: DataFrame) -> DataFrame:
    """List name, or the default for items in no list; the default id is -1. Lists are joined as Spark sees fit."""
    out = items.join(lists, "list_id", "left")
    name = F.when(F.col("list_id").isNull(), UNCATEGORIZED).otherwise(F.col("list_name"))
    return out.withColumns({"list_name": name, "list_id": F.coalesce("list_id", F.lit(NO_LIST))})


def merged_results(literal: DataFrame, semantic: DataFrame) -> DataFrame:
    """Union of two hit lists (item_id, position), one row an item: literal hits first, each in its order."""
    both = literal.withColumn("source", F.lit(0)).unionByName(semantic.withColumn("source", F.lit(1)))
    first = both.groupBy("item_id").agg(F.min(F.struct("source", "position")).alias("at"))
    return first.select("item_id", F.col("at.source").alias("source"), F.col("at.position").alias("position"))
