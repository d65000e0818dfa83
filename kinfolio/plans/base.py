"""Registration of queries, and the views that bind the operators to the generated tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir), with the SQL that checks it."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items: embeddings, part, documents and orders on equal keys; some languages and lists are null."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", F.col("label").alias("cluster_id"))
    brand = F.regexp_replace("p_brand", "Brand#", "").cast("int")
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("name"),
        F.concat("p_brand", F.lit("/"), "p_name").alias("full_name"),
        F.nullif("p_type", F.lit("PROMO")).alias("language"),
        F.split("p_name", " ").alias("topics"),
        F.array(F.col("p_brand"), F.concat("p_type", F.lit(", "), F.split("p_name", " ")[0]), F.concat(F.upper(F.split("p_name", " ")[1]), F.lit("_x"))).alias("tags"),
        F.nullif(brand, F.lit(7)).alias("list_id"),
    )
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("description"))
    dates = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"), F.floor("o_totalprice").cast("long").alias("stars"), F.col("o_orderdate").cast("timestamp").alias("starred_at")
    )
    return vectors.join(parts, "item_id").join(texts, "item_id").join(dates, "item_id")


ITEMS = """items AS (
  SELECT e.vec_id AS item_id, e.embedding, e.label AS cluster_id, p.p_name AS name, concat(p.p_brand, '/', p.p_name) AS full_name,
    nullif(p.p_type, 'PROMO') AS language, string_split(p.p_name, ' ') AS topics,
    [p.p_brand, concat(p.p_type, ', ', string_split(p.p_name, ' ')[1]), concat(upper(string_split(p.p_name, ' ')[2]), '_x')] AS tags,
    nullif(CAST(replace(p.p_brand, 'Brand#', '') AS INT), 7) AS list_id, d.text AS description,
    CAST(floor(o.o_totalprice) AS BIGINT) AS stars, o.o_orderdate AS starred_at
  FROM embeddings e JOIN part p ON p.p_partkey = e.vec_id JOIN documents d ON d.doc_id = e.vec_id JOIN orders o ON o.o_orderkey = e.vec_id
)"""


def with_items(body: str, *more: str) -> str:
    return "WITH " + ", ".join([ITEMS, *more]) + "\n" + body


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster table derived from the items: id, name, description, keywords, color of even ids only, item_count."""
    it = items(spark, sf_dir)
    grouped = it.groupBy("cluster_id").agg(F.count("*").alias("item_count"), F.min("name").alias("name"), F.max("name").alias("last_name"))
    return grouped.select(
        "cluster_id", "name", F.concat(F.lit("group of "), "name").alias("description"), F.split(F.col("last_name"), " ").alias("keywords"),
        F.when(F.col("cluster_id") % 2 == 0, F.concat(F.lit("#AA000"), F.col("cluster_id").cast("string"))).alias("color"), "item_count",
    )


CLUSTERS = """clusters AS (
  SELECT cluster_id, min(name) AS name, concat('group of ', min(name)) AS description, string_split(max(name), ' ') AS keywords,
    CASE WHEN cluster_id % 2 = 0 THEN concat('#AA000', cluster_id) END AS color, count(*) AS item_count
  FROM items GROUP BY cluster_id
)"""


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List table: nations stand for named lists, suppliers' counts for their sizes."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("list_id"), F.col("n_name").alias("list_name"))
    return nations.where("list_id % 5 <> 0")


LISTS = "lists AS (SELECT n_nationkey AS list_id, n_name AS list_name FROM nation WHERE n_nationkey % 5 <> 0)"
