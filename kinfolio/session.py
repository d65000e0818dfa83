"""Session helpers: shared scratch space, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side may be broadcast once both are known.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20

_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Only where that is
    unset in a local session, as in tests, does a temporary folder stand in; a cluster
    without it is an error, because its executors share no temporary folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="kinfolio-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame, ending its lineage and its size estimates.

    A written table rather than checkpoint(): a checkpointed plan keeps the estimates of
    the plan it came from, and these grow without bound where loops join their own results.
    """
    return scratch_table(df, "cut")


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the scratch tables written within; results have to be written by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a (materialised) frame has at most ``limit`` rows and about ``most_bytes`` bytes.

    Both are aggregated where the rows are; bytes only where the row count already fits.
    """
    if df.count() > limit:
        return False
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return (size or 0) <= most_bytes


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only for a side whose rows and bytes have been checked.

    Beyond the limits the frame comes back unchanged, and Spark plans a shuffled join.
    """
    return F.broadcast(df) if small(df, limit, most_bytes) else df
