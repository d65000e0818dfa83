"""An inverted-list index of vectors: candidates for relevance jobs beyond a quadratic size.

Spherical k-means makes the lists' centers, from a bounded sample; every item goes to the list of its
nearest center and is stored in it. A query asks its nearest lists only, as many as gave a sample of
queries the wanted share of their exact neighbours. Crowded lists are cut into blocks of items and, where many queries probe them, of queries, so that a
(list, query block, item block) group is bounded and no list is a single task's.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfolio.session import scratch_table

#: Most lists, and most items that centers are fitted on. Both bound what a task and the driver hold.
MOST_LISTS = 4096
SAMPLE_ITEMS = 200_000
#: Queries, about, and neighbours of each that the number of lists to probe is measured on.
SAMPLE_QUERIES, SAMPLE_NEIGHBOURS = 200, 20


class ListIndex:
    """Unit centers, one row a list, the stored items with their ``list``, and how many lists to probe.

    That number is given, or measured when it is first asked for.
    """

    def __init__(self, centers: np.ndarray, postings: DataFrame, probes: int | Callable[[ListIndex], int] = MOST_LISTS):
        self.centers, self.postings, self._probes = centers, postings, probes

    @property
    def probes(self) -> int:
        if callable(self._probes):
            self._probes = self._probes(self)
        return self._probes

    @probes.setter
    def probes(self, probes: int) -> None:
        self._probes = probes

    def save(self, path: str) -> None:
        """Writes the postings, dealt by list, and the centers under ``path``."""
        spark = self.postings.sparkSession
        self.postings.repartition("list").sortWithinPartitions("list").write.mode("overwrite").parquet(f"{path}/postings")
        rows = [(i, c.tolist(), self.probes) for i, c in enumerate(self.centers)]
        spark.createDataFrame(rows, "list int, center array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centers")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ListIndex:
        rows = spark.read.parquet(f"{path}/centers").orderBy("list").limit(MOST_LISTS).collect()
        return ListIndex(np.array([r.center for r in rows], dtype=float), spark.read.parquet(f"{path}/postings"), rows[0].probes)


def _matrix(batch: pa.RecordBatch, vector: str) -> np.ndarray:
    return batch.column(vector).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def with_lists(rows: DataFrame, centers: np.ndarray, n: int, vector: str = "v") -> DataFrame:
    """Adds ``lists``, the ``n`` nearest centers of each row by cosine, nearest first."""
    n = min(n, len(centers))
    fields = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # As many rows at a time as make a few million cosines.
        rows_at_once = max(1, (1 << 22) // len(centers))
        for batch in (b.slice(i, rows_at_once) for b in batches for i in range(0, b.num_rows, rows_at_once)):
            m = _matrix(batch, vector)
            near = m @ centers.T
            top = np.argpartition(-near, n - 1, axis=1)[:, :n] if n < near.shape[1] else np.tile(np.arange(n), (len(m), 1))
            order = np.lexsort((top, -np.take_along_axis(near, top, axis=1)), axis=1)
            best = np.take_along_axis(top, order, axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(best), pa.list_(pa.int32()))], names=[*batch.schema.names, "lists"])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lists array<int>"])
    return rows.mapInArrow(run, ddl)


def probes_needed(index: ListIndex, recall: float, count: int) -> int:
    """Fewest lists that hold the share ``recall`` of the exact nearest items of a sample of queries."""
    chosen = F.pmod(F.xxhash64("item_id", F.lit("query")), F.lit(count)) < SAMPLE_QUERIES
    asked = [r.v for r in index.postings.where(chosen).select("v").limit(2 * SAMPLE_QUERIES).collect()]
    if not asked:
        return len(index.centers)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    queries = unit(np.array(asked, dtype=float))
    # One more: a query finds itself.
    k = SAMPLE_NEIGHBOURS + 1

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = unit(_matrix(batch, "v")) @ queries.T
            if k < len(near):
                # Those that reach a query's k-th nearest, about; the order below settles the rest.
                top = np.argpartition(-near, k - 1, axis=0)[:k]
            else:
                top = np.tile(np.arange(len(near))[:, None], near.shape[1])
            at = batch.column("list").take(pa.array(top.T.ravel()))
            query = np.repeat(np.arange(len(queries)), len(top))
            yield pa.record_batch([pa.array(query), pa.array(np.take_along_axis(near, top, axis=0).T.ravel()), at], names=["query", "near", "list"])

    found = index.postings.select("v", "list").mapInArrow(nearest, "query long, near double, list int")
    best = F.row_number().over(W.partitionBy("query").orderBy(F.desc("near"), "list"))
    held = found.withColumn("rank", best).where(F.col("rank").between(2, k)).groupBy("query", "list").count().collect()
    order = np.argsort(np.argsort(-(queries @ index.centers.T), axis=1, kind="stable"), axis=1)
    places = np.bincount([order[r["query"], r["list"]] for r in held], weights=[r["count"] for r in held], minlength=len(index.centers))
    return int(np.searchsorted(np.cumsum(places), recall * places.sum() - 1e-9)) + 1


def build(rows: DataFrame, lists: int | None = None, seed: int = 7, sample: int = SAMPLE_ITEMS, recall: float = 0.95) -> ListIndex | None:
    """The index of prepared items (with a vector ``v``); None where there are none.

    By default the square root of the number of items, and at most MOST_LISTS lists. Centers
    are fitted on about ``sample`` items, chosen by a hash of their ids; all items are
    stored. Queries probe as many lists as have the share ``recall`` of the exact neighbours of a sample.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    # Cut off here: it is counted, fitted on and stored.
    rows = scratch_table(rows, "indexed")
    count = rows.count()
    if not count:
        return None
    lists = max(1, min(lists or math.isqrt(count), MOST_LISTS, count))
    fitted = rows if count <= sample else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) < sample)
    # Not by a lambda over the values: it would add up the length again for each of them.
    vectors = fitted.select(array_to_vector(F.col("v").cast("array<double>")).alias("v"))
    unit = Normalizer(inputCol="v", outputCol="x").transform(vectors).select("x")
    centers = np.array(KMeans(featuresCol="x", k=lists, seed=seed, maxIter=10).fit(unit).clusterCenters())
    centers = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    stored = with_lists(rows, centers, 1).withColumn("list", F.get("lists", 0)).drop("lists")
    return ListIndex(centers, scratch_table(stored, "lists"), lambda index: probes_needed(index, recall, count))


def meeting(index: ListIndex, queries: DataFrame, probes: int, block: int, asked_block: int | None = None) -> DataFrame:
    """Queries (``side`` 0) and stored items (1) in the groups ``list, qb, ib`` where they meet.

    A query is in ``probes`` lists, and there in one block of queries (``asked_block``, or as many as
    of items) with every block of items. Both have the columns of the queries.
    """
    asked = with_lists(queries, index.centers, probes).withColumn("list", F.explode("lists")).drop("lists")
    blocks = lambda rows, name, n: rows.groupBy("list").agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    # At most MOST_LISTS rows.
    sizes = F.broadcast(blocks(index.postings, "ibs", block).join(blocks(asked, "qbs", asked_block or block), "list"))
    own = lambda n: F.pmod(F.xxhash64("item_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, "list").withColumn("qb", own("qbs")).withColumn("ib", every("ibs")).withColumn("side", F.lit(0))
    right = index.postings.select(*queries.columns, "list").join(sizes, "list").withColumn("ib", own("ibs")).withColumn("qb", every("qbs")).withColumn("side", F.lit(1))
    return left.drop("ibs", "qbs").unionByName(right.drop("ibs", "qbs"))
