"""Change detection, upserts and incremental state of the item table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfolio.functions.text import changed, content_hash, topics_hash

#: Columns that a changed item loses until it is processed again.
DERIVED = ("embedding", "summary", "tags")
#: Columns that a known item takes from the source; all others stay as they were.
UPDATED = ("description", "language", "topics", "stars", "forks", "updated_at", "pushed_at", "avatar_url")


def hashed(items: DataFrame) -> DataFrame:
    return items.withColumns({"description_hash": content_hash(F.col("description")), "topics_hash": topics_hash(F.col("topics"))})


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row a key: the last in the order."""
    last = W.partitionBy(key).orderBy(*(c.desc_nulls_last() for c in order))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def after_cutoff(records: DataFrame, watermark: str | None, ts: str = "starred_at") -> DataFrame:
    """Records later than the watermark, and those without a date, with ``was_truncated``: whether any was left out."""
    if watermark is None:
        return records.withColumn("was_truncated", F.lit(False))
    mark = F.lit(watermark).cast("timestamp")
    kept = records.where(F.col(ts).isNull() | (F.col(ts) > mark))
    old = records.agg(F.coalesce(F.max(F.col(ts) <= mark), F.lit(False)).alias("was_truncated"))
    return kept.join(old)


def classify(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """``item_id, state``: new, changed or unchanged, by the hashes of description and topics."""
    new = hashed(incoming).select("item_id", F.col("description_hash").alias("nd"), F.col("topics_hash").alias("nt"))
    old = stored.select("item_id", F.col("description_hash").alias("od"), F.col("topics_hash").alias("ot"), F.lit(True).alias("known"))
    state = F.when(F.col("known").isNull(), "new").when(changed(F.col("od"), F.col("nd")) | changed(F.col("ot"), F.col("nt")), "changed")
    return new.join(old, "item_id", "left").select("item_id", state.otherwise("unchanged").alias("state"))


def refresh_targets(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    return classify(incoming, stored).where("state <> 'unchanged'")


def upsert(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored table after an upsert; running it twice changes nothing more.

    New items come in whole. Known items take the columns of ``UPDATED`` that the source
    has; where a hash differs they lose the derived columns, too.
    """
    fresh = hashed(incoming)
    shared = [c for c in stored.columns if c in fresh.columns and c != "item_id"]
    new = fresh.select("item_id", F.lit(True).alias("_in"), *(F.col(c).alias(f"_{c}") for c in shared))
    both = stored.withColumn("_old", F.lit(True)).join(new, "item_id", "full_outer")
    known, seen = F.col("_old").isNotNull(), F.col("_in").isNotNull()
    differs = changed(F.col("description_hash"), F.col("_description_hash")) | changed(F.col("topics_hash"), F.col("_topics_hash"))
    out = []
    for c in stored.columns:
        if c == "item_id":
            out.append(F.col(c))
            continue
        own, given = F.col(c), F.col(f"_{c}") if c in shared else F.lit(None)
        value = F.when(~known, given)
        if c in DERIVED:
            value = value.when(seen & differs, F.lit(None))
        elif c in UPDATED or c.endswith("_hash"):
            value = value.when(seen, given) if c in shared else value
        out.append(value.otherwise(own).alias(c))
    return both.select(out)


def delete_missing(stored: DataFrame, source: DataFrame) -> DataFrame:
    """Stored items that the source still has."""
    return stored.join(source.select("item_id").distinct(), "item_id", "left_semi")


def removed(stored: DataFrame, source: DataFrame) -> DataFrame:
    return stored.join(source.select("item_id").distinct(), "item_id", "left_anti").select("item_id")


def assign_lists(items: DataFrame, members: DataFrame) -> DataFrame:
    """List id from membership rows (item_id, list_id, list_order); the last list wins, others keep theirs."""
    won = members.groupBy("item_id").agg(F.max_by("list_id", "list_order").alias("_new"))
    return items.join(won, "item_id", "left").withColumn("list_id", F.coalesce("_new", "list_id")).drop("_new")


def reset(items: DataFrame, *columns: str) -> DataFrame:
    """Derived columns and hashes emptied, so that all is processed again."""
    kinds = dict(items.dtypes)
    return items.withColumns({c: F.lit(None).cast(kinds[c]) for c in columns if c in kinds})


def sync(incoming: DataFrame, stored: DataFrame, full: bool = True) -> tuple[DataFrame, DataFrame]:
    """The table after a sync, and one row of counters: new, changed, unchanged and removed."""
    states = classify(incoming, stored)
    counts = states.agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("new", "changed", "unchanged")))
    gone = removed(stored, incoming).agg(F.count("*").alias("removed")) if full else counts.select(F.lit(0).cast("long").alias("removed"))
    base = delete_missing(stored, incoming) if full else stored
    return upsert(incoming, base), counts.join(gone)


def upsert_feedback(stored: DataFrame, incoming: DataFrame, items: DataFrame) -> DataFrame:
    """Last feedback of each (user, anchor, candidate); both items have to exist."""
    ids = items.select("item_id").distinct()
    valid = incoming
    for c in ("anchor", "candidate"):
        valid = valid.join(ids.withColumnRenamed("item_id", c), c, "left_semi")
    both = stored.unionByName(valid.select(stored.columns))
    last = W.partitionBy("user_id", "anchor", "candidate").orderBy(F.desc("ts"), F.desc("verdict"))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def stale_anchors(items: DataFrame, cached: DataFrame) -> DataFrame:
    """Anchors whose cached list is missing or older than the item or the last sync."""
    fresh = cached.select("item_id", F.col("anchor_updated_at").alias("_u"), F.col("synced_at").alias("_s"))
    same = (F.col("_u").eqNullSafe(F.col("updated_at"))) & (F.col("_s").eqNullSafe(F.col("synced_at")))
    return items.join(fresh, "item_id", "left").where(F.col("_u").isNull() | ~same).select("item_id")


def rehydrate(cached: DataFrame, items: DataFrame, limit: int = 20) -> DataFrame:
    """Cached lists (item_id, related array of ids) as live rows in their order; vanished items are skipped."""
    rows = cached.select("item_id", F.posexplode("related").alias("pos", "target"))
    live = rows.join(items.withColumnRenamed("item_id", "target"), "target")
    rank = F.row_number().over(W.partitionBy("item_id").orderBy("pos"))
    return live.withColumn("rank", rank).where(F.col("rank") <= limit)
