"""Exact order statistics by refined histograms: no group's rows are ordered or gathered.

A round counts the rows of each group in equal intervals of what is left of its range,
and goes on with the interval that holds the wanted rank, down to a single value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfolio.session import broadcast_if_small, cut

#: Intervals of a round.
BUCKETS = 256
#: Rows of the largest group up to which Spark's own exact percentile is used.
LARGE_GROUP = 1_000_000


def _bucket(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.floor((x - low) / ((high - low) / BUCKETS)), F.lit(BUCKETS - 1)).cast("int")


def percentiles(rows: DataFrame, group: str, value: str, q: float, name: str, large: int = LARGE_GROUP) -> DataFrame:
    """``group, name``: the exact percentile of each group's non-null values, with linear interpolation.

    ``rows`` is read several times, so it should be a written table. Groups of up to ``large``
    rows are left to Spark's percentile, which holds a group's values in one task.
    """
    rows = rows.select(group, F.col(value).cast("double").alias("x")).where("x is not null")
    sizes = cut(rows.groupBy(group).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")))
    biggest = sizes.agg(F.max("n")).first()[0] or 0
    if biggest <= large:
        return rows.groupBy(group).agg(F.percentile("x", q).alias(name))
    place = (F.col("n") - 1) * F.lit(q)
    ranks = F.array(F.struct(F.lit(0).alias("end"), F.floor(place).alias("rank")), F.struct(F.lit(1).alias("end"), F.ceil(place).alias("rank")))
    state = cut(sizes.select(group, place.alias("place"), "low", "high", F.lit(0).cast("long").alias("below"), F.explode(ranks).alias("r")).select(group, "place", "low", "high", "below", "r.*"))
    done: list[DataFrame] = []
    while True:
        done.append(state.where("low = high"))
        state = cut(state.where("low < high"))
        if state.isEmpty():
            break
        met = rows.join(broadcast_if_small(state.select(group, "end", "low", "high")), group).where("x between low and high")
        counts = met.groupBy(group, "end", _bucket(F.col("x"), F.col("low"), F.col("high")).alias("b")).agg(F.count("*").alias("m"), F.min("x").alias("least"), F.max("x").alias("most"))
        # At most BUCKETS rows for each of a group's two ranks.
        up_to = F.sum("m").over(W.partitionBy(group, "end").orderBy("b"))
        stepped = counts.withColumn("up_to", up_to).join(state.select(group, "end", "rank", "below", "place"), [group, "end"])
        here = stepped.where((F.col("below") + F.col("up_to") > F.col("rank")) & (F.col("below") + F.col("up_to") - F.col("m") <= F.col("rank")))
        state = cut(here.select(group, "place", F.col("least").alias("low"), F.col("most").alias("high"), (F.col("below") + F.col("up_to") - F.col("m")).alias("below"), "end", "rank"))
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    both = found.groupBy(group).agg(F.first("place").alias("place"), F.min_by("low", "end").alias("a"), F.max_by("low", "end").alias("b"))
    part = F.col("place") - F.floor("place")
    return both.select(group, F.when(part == 0, F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b")).alias(name))


def nth_smallest(rows: DataFrame, value: str, rank: int) -> float | None:
    """The value with ``rank`` smaller or equal ones before it (from 0), of all rows; None where there are fewer.

    A round brings at most BUCKETS counts to the driver.
    """
    rows = rows.select(F.col(value).cast("double").alias("x")).where("x is not null")
    low, high, n = rows.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if rank >= n:
        return None
    below = 0
    while low < high:
        met = rows.where(F.col("x").between(low, high)).groupBy(_bucket(F.col("x"), F.lit(low), F.lit(high)).alias("b"))
        for r in sorted(met.agg(F.count("*").alias("m"), F.min("x").alias("least"), F.max("x").alias("most")).collect(), key=lambda r: r.b):
            if below + r.m > rank:
                low, high = r.least, r.most
                break
            below += r.m
    return low
