"""Token ids as fixed-width packed binary files.

Every id takes the minimum number of bits for the vocabulary. Documents are range
partitioned by id, and each partition becomes a file of frames. A frame is one
binary value, little-endian:

    8 bytes   magic ``KPACKED1``
    uint32    bits per id
    uint32    ids per block
    uint64    number of ids
    uint32    number of blocks
    uint64[]  byte offset of each block in the body
    body      blocks, each padded to whole bytes

so one block, or any range of ids, unpacks without the rest. Frames travel in
Parquet files, so that Spark's committer makes retried and lost tasks harmless.

Nulls count as the empty text (the end id alone). A null document id sorts first,
equal ids by their text's hash and then freely. An empty table writes an empty file
set. Extra columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfolio.llm.common import keeps, slices, texts_of, tidy
from kinfolio.llm.token_units import UnitCache, Vocabulary, encode_texts
from kinfolio.session import broadcast_if_small, cut

MAGIC = b"KPACKED1"
BLOCK_IDS = 4096
#: Units that go to the tokenizers library in one call.
JOINED_UNITS = 4096
#: Layout of a frame row in the files.
FRAME_SCHEMA = "shard int, frame int, doc_ids array<long>, counts array<int>, payload binary"


def bits_for(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int, block: int = BLOCK_IDS) -> bytes:
    """One frame holding ``ids``."""
    n = len(ids)
    blocks = -(-n // block) if n else 0
    step = -(-block * bits // 8)
    if bits in (8, 16, 32):
        body = ids.astype(f"<u{bits // 8}").tobytes()
    else:
        padded = np.zeros(blocks * block, dtype=np.uint32)
        padded[:n] = ids
        spread = (padded[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
        body = np.packbits(spread.astype(np.uint8).reshape(blocks, block * bits), axis=1, bitorder="little").tobytes()
        last = -(-(n - (blocks - 1) * block) * bits // 8) if blocks else 0
        body = body[: (blocks - 1) * step + last] if blocks else b""
    offsets = np.arange(blocks, dtype="<u8") * step
    head = MAGIC + np.array([bits, block], dtype="<u4").tobytes() + np.array([n], dtype="<u8").tobytes()
    return head + np.array([blocks], dtype="<u4").tobytes() + offsets.tobytes() + body


def unpack(frame: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a frame (uint32), reading only the blocks that hold them."""
    if frame[:8] != MAGIC:
        raise ValueError("not a packed id frame")
    bits, block = (int(x) for x in np.frombuffer(frame, "<u4", 2, 8))
    n = int(np.frombuffer(frame, "<u8", 1, 16)[0])
    blocks = int(np.frombuffer(frame, "<u4", 1, 24)[0])
    stop = n if stop is None else min(stop, n)
    if stop <= start:
        return np.empty(0, dtype=np.uint32)
    offsets = np.frombuffer(frame, "<u8", blocks, 28)
    body = 28 + 8 * blocks
    first, last = start // block, (stop - 1) // block
    if bits in (8, 16, 32):
        at = body + int(offsets[first]) + (start - first * block) * bits // 8
        return np.frombuffer(frame, f"<u{bits // 8}", stop - start, at).astype(np.uint32)
    parts = []
    for b in range(first, last + 1):
        have = min(block, n - b * block)
        raw = np.frombuffer(frame, np.uint8, -(-have * bits // 8), body + int(offsets[b]))
        grid = np.unpackbits(raw, bitorder="little")[: have * bits].reshape(have, bits)
        parts.append(grid.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32)))
    return np.concatenate(parts)[start - first * block : stop - first * block]


class LibraryEncoder:
    """The tokenizers library behind a unit cache: each distinct word is encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = list(Vocabulary(path).special)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.units = UnitCache(self._encode)
        self.divider = self.specials[0] if self.specials else None
        self.divider_id = self.tokenizer.token_to_id(self.divider) if self.specials else -1

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and lengths. Many units go to the library as one string, divided by a special token."""
        if self.divider is None or any("<" in u and any(s in u for s in self.specials) for u in units):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
            flat = np.array([i for x in ids for i in x], dtype=np.int32)
            return flat, np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        parts = []
        for i in range(0, len(units), JOINED_UNITS):
            # Closed by a divider too, so that each unit's ids end at one.
            text = self.divider.join([*units[i : i + JOINED_UNITS], ""])
            parts.append(np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int32))
        flat = np.concatenate([*parts, np.empty(0, dtype=np.int32)])
        ends = np.flatnonzero(flat == self.divider_id)
        return flat[flat != self.divider_id], np.diff(ends, prepend=-1) - 1


@lru_cache(maxsize=2)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


keeps("packed_ids", encoder.cache_clear)


def frames(docs: DataFrame, vocab_path: str, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Packed frames of all documents, range partitioned and ordered by ``key`` (a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, frame = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text"):
            lib = encoder(vocab_path)
            ids, counts = encode_texts(texts_of(batch, "text"), lib.units, lib.specials)
            closed = np.insert(ids, np.cumsum(counts), end_id)
            row = [[shard], [frame], [batch.column("key").to_pylist()], [(counts + 1).tolist()], [pack(closed, bits_for(lib.size))]]
            types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            yield pa.record_batch([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=["shard", "frame", "doc_ids", "counts", "payload"])
            frame += 1

    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    source = source.withColumn("tie", F.xxhash64("text"))
    ordered = source.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").drop("tie")
    return ordered.mapInArrow(tidy(run, "packed_ids"), FRAME_SCHEMA)


def write(docs: DataFrame, path: str, vocab_path: str, end_id: int = 0, text: str = "text", key: str = "doc_id") -> None:
    """Write the packed files of ``docs`` under ``path``."""
    frames(docs, vocab_path, end_id, text, key).write.mode("overwrite").option("compression", "uncompressed").parquet(path)


def frame_starts(spark: SparkSession, path: str) -> DataFrame:
    """``shard, frame, base``: the number of ids in all frames before each one.

    A running sum within each shard, and the sums of whole shards before it. There is
    one row a shard in the second sum, so its size is the number of files.
    """
    from pyspark.sql import Window as W

    sizes = spark.read.schema(FRAME_SCHEMA).parquet(path).select(
        "shard", "frame", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")
    )
    inside = W.partitionBy("shard").orderBy("frame").rowsBetween(W.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("total"))
    ahead = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead"))
    return sizes.join(shards, "shard").select(
        "shard", "frame", (F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("ahead")).alias("base")
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids array<long>`` from packed files."""
    return _scan(spark, path, "doc_id long, start long, n_tokens long, ids array<long>", lambda ids: ids.astype(np.int64).tolist(), pa.list_(pa.int64()))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from packed files."""
    return _scan(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4")), pa.int64())


def _scan(spark: SparkSession, path: str, schema: str, of, kind: pa.DataType) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                base, doc_ids, counts, payload = (batch.column(c)[i] for c in ("base", "doc_ids", "counts", "payload"))
                counts = np.array(counts.as_py(), dtype=np.int64)
                ids = unpack(payload.as_py())
                ends = np.cumsum(counts)
                starts = ends - counts
                values = [of(ids[s:e]) for s, e in zip(starts, ends, strict=True)]
                yield pa.record_batch(
                    [pa.array(doc_ids.as_py(), pa.int64()), pa.array(base.as_py() + starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(values, kind)],
                    names=names,
                )

    data = spark.read.schema(FRAME_SCHEMA).parquet(path)
    starts = broadcast_if_small(cut(frame_starts(spark, path)))
    return data.join(starts, ["shard", "frame"]).select("base", "doc_ids", "counts", "payload").mapInArrow(tidy(run, "packed_ids"), schema)
