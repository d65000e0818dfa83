"""Quality of rankings and clusters, and the gates on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Least precision at 5, coverage and purity.
GATES = {"precision_at_k": 0.80, "coverage": 0.95, "purity": 0.75}


def ranking(goldset: DataFrame, predictions: DataFrame, k: int = 5) -> DataFrame:
    """Per anchor ``precision, ndcg, covered`` of goldset (anchor, positives) and predictions (anchor, predicted).

    Anchors without predictions score 0 and aren't covered.
    """
    both = goldset.join(predictions, "anchor", "left").withColumn("predicted", F.coalesce("predicted", F.array().cast("array<long>")))
    top = F.slice("predicted", 1, k)
    hit = lambda x: F.array_contains("positives", x)
    gains = F.transform(top, lambda x, i: F.when(hit(x), 1.0 / F.log2(i + F.lit(2.0))).otherwise(0.0))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    ideal = F.transform(F.slice(F.array_repeat(F.lit(1), k), 1, F.least(F.greatest(F.size(F.array_distinct("positives")), F.lit(0)), F.lit(k))), lambda _, i: 1.0 / F.log2(i + F.lit(2.0)))
    return both.select(
        "anchor",
        (F.size(F.filter(top, hit)) / F.lit(k)).alias("precision"),
        F.when(total(ideal) > 0, total(gains) / total(ideal)).otherwise(0.0).alias("ndcg"),
        (F.size("predicted") > 0).alias("covered"),
    )


def ranking_summary(goldset: DataFrame, predictions: DataFrame, k: int = 5) -> DataFrame:
    """One row: mean precision and nDCG over all anchors, and the share with predictions."""
    scored = ranking(goldset, predictions, k)
    return scored.agg(
        F.count("*").alias("anchors"), F.coalesce(F.avg("precision"), F.lit(0.0)).alias("precision_at_k"),
        F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("ndcg_at_k"), F.coalesce(F.avg(F.col("covered").cast("int")), F.lit(0.0)).alias("coverage"),
    )


def purity(rows: DataFrame) -> DataFrame:
    """One row ``purity, coverage`` of rows (item_id, cluster_id, label); noise (-1) counts for coverage only."""
    inside = rows.where("cluster_id <> -1").groupBy("cluster_id", "label").agg(F.count("*").alias("n"))
    best = inside.groupBy("cluster_id").agg(F.max("n").alias("best"), F.sum("n").alias("n")).agg(F.sum("best").alias("best"), F.sum("n").alias("n"))
    share = F.coalesce(F.col("best") / F.col("n"), F.lit(0.0))
    return best.join(rows.agg(F.count("*").alias("total"))).select(
        share.alias("purity"), F.when(F.col("total") > 0, F.coalesce("n", F.lit(0)) / F.col("total")).otherwise(0.0).alias("coverage")
    )


def gates(metrics: DataFrame) -> DataFrame:
    """``passed`` and the names of the failed gates, of a one-row frame with the gated columns."""
    failed = F.array_compact(F.array(*(F.when(F.col(c) < least, F.lit(c)) for c, least in GATES.items() if c in metrics.columns)))
    return metrics.select((F.size(failed) == 0).alias("passed"), failed.alias("failed"))
