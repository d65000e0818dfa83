"""Runs and their steps as a table: latest and active runs, outcomes, progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP_SCHEMA = "run_id long, step string, position int, status string, failed_items long, message string"


def latest_run(runs: DataFrame) -> DataFrame:
    """Newest run of each user."""
    return runs.groupBy("user_id").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))


def active_run(runs: DataFrame) -> DataFrame:
    return latest_run(runs.where(F.col("status").isin("pending", "running")))


def outcome(steps: DataFrame) -> DataFrame:
    """Per run: failed if a step failed, partial_failed if items failed, else completed; with the messages in step order."""
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("message").isNotNull(), F.struct("position", "message")))), lambda x: x["message"]), "; ")
    grouped = steps.groupBy("run_id").agg(F.max((F.col("status") == "failed").cast("int")).alias("f"), F.sum("failed_items").alias("failed_items"), listed.alias("messages"))
    status = F.when(F.col("f") == 1, "failed").when(F.col("failed_items") > 0, "partial_failed").otherwise("completed")
    return grouped.select("run_id", status.alias("status"), "failed_items", "messages")


def refresh_report(steps: DataFrame) -> DataFrame:
    """Per run the list of steps whose items failed in part."""
    bad = steps.where((F.col("status") == "completed") & (F.col("failed_items") > 0))
    return bad.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("position", "step", "failed_items"))).alias("partial"))


def run_pipeline(spark: SparkSession, run_id: int, steps: list[tuple[str, Callable[[], int]]]) -> DataFrame:
    """Runs steps (each returns its number of failed items) in order until one raises; returns the ledger rows."""
    rows = []
    for i, (name, step) in enumerate(steps):
        try:
            failed = int(step())
            rows.append((run_id, name, i, "completed", failed, f"{name}: {failed} failed" if failed else None))
        except Exception as e:  # a step's failure is a result of the run
            rows.append((run_id, name, i, "failed", 0, f"{name}: {e}"))
            break
    return spark.createDataFrame(rows, STEP_SCHEMA)
