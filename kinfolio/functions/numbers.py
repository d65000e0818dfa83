"""Sizes, counts, calendar and progress as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_size(stars: Column) -> Column:
    """Size of a graph node: 1 and half the logarithm of the stars."""
    return 1.0 + F.log10(F.greatest(stars, F.lit(1)).cast("double")) * 0.5


def layout_size(stars: Column) -> Column:
    """Size used by the layout, at most 3."""
    return F.least(0.5 * F.log10((F.greatest(stars, F.lit(1)) + 1).cast("double")) + 0.5, F.lit(3.0))


def node_radius(stars: Column) -> Column:
    """Radius in a 2-D drawing, between 5 and 30."""
    return F.least(F.greatest(5.0 * F.log10((F.greatest(stars, F.lit(1)) + 1).cast("double")), F.lit(5.0)), F.lit(30.0))


def estimate_clusters(n: Column, least: int = 3) -> Column:
    """The square root of the number of items, between ``least`` and 20, at most the number."""
    root = F.floor(F.sqrt(n.cast("double")))
    return F.least(F.greatest(F.lit(least), F.least(root, n, F.lit(20))), n).cast("long")


def force_full(total: Column, new: Column, drift: Column, ratio: float = 0.2, limit: float = 0.35) -> Column:
    """Whether so much is new, or centroids moved so far, that clusters are built anew."""
    share = F.when(total > 0, new / total).otherwise(F.lit(1.0))
    return (share > ratio) | F.coalesce(drift > limit, F.lit(False))


def cluster_params(n: Column, most: Column, least: Column) -> Column:
    """Clustering parameters as a struct, from the number of items and the wanted numbers of clusters (``least`` may be null)."""
    within = lambda x, low, high: F.greatest(F.lit(low), F.least(x, high if isinstance(high, Column) else F.lit(high)))
    third = lambda x: F.floor(x / 3).cast("long")
    most = within(most.cast("long"), 2, 20)
    fewest = F.when(least.isNull(), F.greatest(F.lit(2), third(most))).otherwise(within(least.cast("long"), 2, most))
    size = within(F.floor(n / 20).cast("long"), 3, 10)
    return F.struct(
        most.alias("target_max_clusters"), fewest.alias("min_clusters"), size.alias("min_cluster_size"),
        within(third(size), 1, 3).alias("min_samples"), within(60 - 2 * most, 15, 60).alias("n_neighbors"),
    )


def progress_percent(total: Column, done: Column) -> Column:
    return F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), done / total * 100.0))).otherwise(F.lit(0.0))


def eta_seconds(elapsed: Column, percent: Column) -> Column:
    """Whole seconds left at the pace so far; null where that can't be told or is 0."""
    left = F.floor(F.greatest(elapsed * (100.0 / percent) - elapsed, F.lit(0.0))).cast("long")
    return F.when((percent > 0) & (percent < 100) & (elapsed > 0) & (left > 0), left)


def job_phase(kind: Column, status: Column, phase: Column) -> Column:
    return (
        F.when(status.isin("completed", "partial_failed"), "completed")
        .when(status == "failed", "failed")
        .otherwise(F.coalesce(F.nullif(phase, F.lit("")), kind))
    )


def cache_key(min_score: Column, min_semantic: Column, limit: Column) -> Column:
    return F.format_string("related-v1|ms=%.4f|sem=%.4f|limit=%d", min_score, min_semantic, limit)


def calendar(ts: Column) -> dict[str, Column]:
    """Month start, Monday of the week, weekend flag and whole epoch seconds."""
    return {
        "month_start": F.date_trunc("month", ts),
        "week_start": F.date_trunc("week", ts),
        "is_weekend": F.dayofweek(ts).isin(1, 7),
        "epoch": F.unix_seconds(ts.cast("timestamp")),
    }


def humanized(seconds: Column) -> Column:
    """A duration in days, hours, minutes and seconds, parts of 0 left out."""
    parts = [("d", 86400, None), ("h", 3600, 24), ("m", 60, 60), ("s", 1, 60)]
    shown = []
    for unit, size, wrap in parts:
        n = F.floor(seconds / size)
        n = n % wrap if wrap else n
        shown.append(F.when(n > 0, F.concat(n.cast("long").cast("string"), F.lit(unit))))
    return F.coalesce(F.nullif(F.concat_ws(" ", *shown), F.lit("")), F.lit("0s"))
