"""Versioned snapshots: written, checked, activated, paged and rolled back.

A snapshot is a set of Parquet folders ``<part>/user_id=/version=``; the active version
of a user is the last row of a small pointer table, appended to after everything else.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = ("nodes", "edges", "timeline", "meta")
POINTERS = "user_id long, version string, activated_at timestamp, seq long"


def version_name(built_at: str, nodes: int, edges: int) -> str:
    return f"snapshot-{built_at}-n{nodes}-e{edges}"


def write(root: str, user_id: int, version: str, **parts: DataFrame) -> None:
    """Each part of one version; writing a version again replaces it."""
    for name, df in parts.items():
        rows = df.withColumns({"user_id": F.lit(user_id).cast("long"), "version": F.lit(version)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("user_id", "version").parquet(f"{root}/{name}")


def read(spark: SparkSession, root: str, part: str, user_id: int, version: str) -> DataFrame:
    """One part of a version; only its folder is scanned."""
    rows = spark.read.parquet(f"{root}/{part}").where((F.col("user_id") == user_id) & (F.col("version") == version))
    return rows.drop("user_id", "version")


def hydrate(spark: SparkSession, root: str, user_id: int, version: str = "active", edges: bool = True) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Nodes, edges in their index order (None without, and then not scanned) and the totals of a version."""
    name = resolve(spark, root, user_id, version)
    links = read(spark, root, "edges", user_id, name).orderBy("edge_index") if edges else None
    return read(spark, root, "nodes", user_id, name), links, read(spark, root, "meta", user_id, name)


def meta(nodes: DataFrame, edges: DataFrame, timeline: DataFrame) -> DataFrame:
    """One row of declared totals."""
    n = nodes.agg(F.count("*").alias("total_nodes"))
    e = edges.agg(F.count("*").alias("total_edges"))
    t = timeline.agg(F.count("*").alias("timeline_points"))
    return n.join(e).join(t)


def consistency(nodes: DataFrame, edges: DataFrame, timeline: DataFrame, declared: DataFrame, ratio: float = 0.95) -> DataFrame:
    """``valid, reason``: declared and actual counts, a timeline, and enough nodes with name and url."""
    n = nodes.agg(F.count("*").alias("n"), F.count_if(F.col("full_name").isNotNull() & F.col("html_url").isNotNull()).alias("whole"))
    e = edges.agg(F.count("*").alias("e"))
    t = timeline.agg(F.count("*").alias("t"))
    row = declared.join(n).join(e).join(t)
    reason = (
        F.when(F.col("total_nodes") != F.col("n"), "node_count_mismatch")
        .when(F.col("total_edges") != F.col("e"), "edge_count_mismatch")
        .when(F.col("t") == 0, "timeline_missing")
        .when((F.col("n") > 0) & (F.col("whole") / F.greatest("n", F.lit(1)) < ratio), "required_fields_missing")
    )
    return row.select(reason.isNull().alias("valid"), F.coalesce(reason, F.lit("ok")).alias("reason"))


def pointers(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(POINTERS).parquet(f"{root}/pointers")
    except AnalysisException:
        return spark.createDataFrame([], POINTERS)


def activate(spark: SparkSession, root: str, user_id: int, version: str) -> None:
    """Move the user's pointer: one more row, written last."""
    last = pointers(spark, root).where(F.col("user_id") == user_id).agg(F.coalesce(F.max("seq"), F.lit(0)).alias("seq"))
    row = last.select(F.lit(user_id).cast("long").alias("user_id"), F.lit(version).alias("version"), F.current_timestamp().alias("activated_at"), (F.col("seq") + 1).alias("seq"))
    row.coalesce(1).write.mode("append").parquet(f"{root}/pointers")


def active_version(spark: SparkSession, root: str, user_id: int) -> str | None:
    row = pointers(spark, root).where(F.col("user_id") == user_id).agg(F.max_by("version", "seq").alias("v")).head()
    return row.v if row else None


def publish(spark: SparkSession, root: str, user_id: int, version: str, nodes: DataFrame, edges: DataFrame, timeline: DataFrame) -> tuple[bool, str]:
    """Write, check what was written, and activate only if it is consistent.

    Totals are counted from the written parts, so that no part is computed twice.
    """
    write(root, user_id, version, nodes=nodes, edges=edges, timeline=timeline)
    write(root, user_id, version, meta=meta(*(read(spark, root, p, user_id, version) for p in ("nodes", "edges", "timeline"))))
    found = consistency(*(read(spark, root, p, user_id, version) for p in PARTS)).head()
    if found.valid:
        activate(spark, root, user_id, version)
    return found.valid, found.reason


def previous(spark: SparkSession, root: str, user_id: int, current: str) -> str | None:
    """The version active last before the current one."""
    rows = pointers(spark, root).where((F.col("user_id") == user_id) & (F.col("version") != current))
    row = rows.orderBy(F.desc_nulls_last("activated_at"), F.desc("seq")).limit(1).head()
    return row.version if row else None


def rollback(spark: SparkSession, root: str, user_id: int, target: str | None = None) -> str:
    """Back to a version, or to the one before; checked first."""
    current = active_version(spark, root, user_id)
    target = target or (previous(spark, root, user_id, current) if current else None)
    if not target:
        raise ValueError("there is no snapshot to go back to")
    found = consistency(*(read(spark, root, p, user_id, target) for p in PARTS)).head()
    if not found.valid:
        raise ValueError(f"snapshot {target} is not consistent: {found.reason}")
    activate(spark, root, user_id, target)
    return target


def resolve(spark: SparkSession, root: str, user_id: int, version: str = "active") -> str:
    """The named version, or the active one; a missing one is an error."""
    name = active_version(spark, root, user_id) if version == "active" else version
    if not name or read(spark, root, "meta", user_id, name).isEmpty():
        raise LookupError(f"no snapshot {version!r}")
    return name
