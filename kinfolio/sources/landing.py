"""Landed JSON records, long texts, goldsets and predictions as tables; metric reports as JSON."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfolio.functions.text import capped

_ITEM = (
    "id: long, full_name: string, name: string, owner: struct<login: string, avatar_url: string>, description: string, language: string, topics: array<string>, "
    "html_url: string, homepage: string, stargazers_count: int, forks_count: int, watchers_count: int, open_issues_count: int, created_at: string, updated_at: string, pushed_at: string"
)
#: A record is a bare item, or ``{starred_at, repo: item}``.
RECORD = f"struct<starred_at: string, repo: struct<{_ITEM}>, {_ITEM}>"
GOLDSET = "anchor_repo_id long, positive_ids array<long>, negative_ids array<long>"
CLUSTER_GOLDSET = "repo_id long, predicted_cluster int, true_label string"


def star_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """Item rows from JSON text lines of either form; missing counters are 0, missing topics empty."""
    r = lines.select(F.from_json(column, RECORD).alias("r")).select("r.*")
    of = lambda name: F.coalesce(F.col(f"repo.{name}"), F.col(name))
    time = lambda c: F.try_to_timestamp(c)
    counters = {c: F.coalesce(of(c), F.lit(0)).alias(c) for c in ("stargazers_count", "forks_count", "watchers_count", "open_issues_count")}
    return r.select(
        of("id").alias("item_id"), of("full_name").alias("full_name"), of("name").alias("name"), of("owner.login").alias("owner"), of("owner.avatar_url").alias("avatar_url"),
        of("description").alias("description"), of("language").alias("language"), F.coalesce(of("topics"), F.array().cast("array<string>")).alias("topics"),
        of("html_url").alias("html_url"), of("homepage").alias("homepage_url"), *counters.values(), time(F.col("starred_at")).alias("starred_at"),
        time(of("created_at")).alias("created_at"), time(of("updated_at")).alias("updated_at"), time(of("pushed_at")).alias("pushed_at"),
    ).where("item_id is not null")


def read_star_records(spark: SparkSession, path: str) -> DataFrame:
    return star_records(spark.read.text(path))


def list_members(payload: DataFrame) -> DataFrame:
    """``list_id, list_name, is_public, list_order, item_id`` from list rows with nested member nodes; missing ids are dropped."""
    rows = payload.select("list_id", "list_name", (~F.col("isPrivate")).alias("is_public"), "list_order", F.explode_outer("items.nodes").alias("node"))
    return rows.select("list_id", "list_name", "is_public", "list_order", F.col("node.databaseId").alias("item_id")).where("item_id > 0")


def landed_text(text: Column, most: int = 10000) -> Column:
    """A long text up to a length; empty becomes null."""
    return capped(text, most)


def _or_empty(read, spark: SparkSession, schema: str) -> DataFrame:
    try:
        return read()
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_goldset(spark: SparkSession, path: str, schema: str = GOLDSET) -> DataFrame:
    """JSON lines, blank ones skipped; a missing file is an empty goldset."""
    return _or_empty(lambda: spark.read.schema(schema).json(path).dropna("all"), spark, schema)


def predictions(text: DataFrame, column: str = "value") -> DataFrame:
    """``anchor, pos, predicted`` from JSON maps of anchor to ordered ids."""
    pairs = text.select(F.explode(F.from_json(column, "map<string,array<long>>")).alias("anchor", "ids"))
    return pairs.select(F.col("anchor").try_cast("long").alias("anchor"), F.posexplode("ids").alias("pos", "predicted"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return predictions(spark.read.text(path, wholetext=True))


def write_report(metrics: DataFrame, path: str) -> None:
    """A one-row metrics frame as one JSON file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)
