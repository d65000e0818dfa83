"""Helpers that the text operators share."""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfolio.session import broadcast_if_small, cut

#: Bytes of text that one vectorised step handles at a time; bounds a worker's memory.
SLICE_BYTES = 2 << 20

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column, separators: str = SPACES) -> Column:
    """The words of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character unchanged."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def crc_mod(doc_id: Column, k: int) -> Column:
    """crc32 of the id's decimal text, modulo ``k``; null ids count as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def sampled(rows: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """Rows whose key's hash is below a share that leaves at most ``most`` of a group's keys (but for 1 in 10,000 cases).

    A group with up to ``most`` rows stays whole. The share follows from a count, so no group's
    rows are ever ordered or gathered; equal keys stay or go together.
    """
    wanted = max(1.0, most - 4 * math.sqrt(most))
    share = F.when(F.col("_n") <= most, F.lit(1.0)).otherwise(F.lit(wanted) / F.col("_n"))
    shares = cut(rows.groupBy(group).agg(F.count("*").alias("_n")).select(group, share.alias("_share")))
    met = rows.join(broadcast_if_small(shares), group)
    return met.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < F.col("_share") * (1 << 40)).drop("_share")


def columns_ddl(fields: list, more: str) -> str:
    """DDL of the given schema fields, followed by more columns."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), more])


def slices(
    batches: Iterator[pa.RecordBatch], *texts: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of its text columns (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = (pc.fill_null(pc.binary_length(batch.column(t)), 0) for t in texts)
        ends = np.cumsum(sum(s.to_numpy(zero_copy_only=False).astype(np.int64) for s in sizes))
        at = 0
        while at < batch.num_rows:
            base = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


_keeps: dict[str, Callable[[], None]] = {}


def keeps(owner: str, forget: Callable[[], None]) -> None:
    """Tells how to free what ``owner``'s tasks keep in a worker from one task to the next."""
    _keeps[owner] = forget


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function that leaves no other operator's memory behind.

    Spark keeps Python workers for later tasks. At its start, what tasks of other owners keep
    is freed; at its end, what Arrow's pool and the allocator hold unused goes back to the
    system. Otherwise these would add up over the operators that a worker has served.
    """

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, forget in _keeps.items():
            if name != owner:
                forget()
        try:
            yield from run(batches)
        finally:
            give_back()

    return outer


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems have no malloc_trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every (start, length), one after another."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - before, lengths)


def texts_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column as a plain Arrow string array without nulls."""
    column = batch.column(name)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "")
