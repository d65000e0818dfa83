"""Structured Streaming: continuous sync of landed records, and windowed attempt counts.

Neither state nor what a batch writes grows with history: windows leave the state once the
watermark has passed them, and a batch of records adds its own rows to a log.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfolio.operators.sync import hashed, latest, upsert
from kinfolio.sources.landing import star_records


def attempts(events: DataFrame, key: str, ts: str, length: str = "5 minutes", slide: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Events of each key in sliding windows. On a stream, rows later than the watermark are dropped."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, late) if events.isStreaming else timed
    return timed.groupBy(F.window(ts, length, slide), key).agg(F.count("*").alias("n"))


def run_attempts(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, ts: str, length: str, slide: str, late: str = "5 minutes") -> None:
    """Appends the counts of windows that the watermark has passed to ``target``, for all there is in a folder of Parquet files.

    Each batch has a partition of its own, which a replay writes anew. Windows that may
    still grow stay in the state; :func:`attempts_now` has both.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    closed = attempts(stream, key, ts, length, slide, late)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    job = closed.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()


def attempts_now(spark: SparkSession, source: str, schema: str, target: str, key: str, ts: str, length: str, slide: str) -> DataFrame:
    """All windows up to now: those closed, and the open ones from the events that reach into them."""
    events = spark.read.schema(schema).parquet(source)
    try:
        closed = spark.read.parquet(target).drop("batch")
    except AnalysisException:  # nothing has been closed yet
        return attempts(events, key, ts, length, slide)
    end = closed.agg(F.max("window.end")).first()[0]
    if end is None:
        return attempts(events, key, ts, length, slide)
    # A window closes for all keys at once, so what ends later is open.
    recent = events.where(F.col(ts).cast("timestamp") >= F.lit(end).cast("timestamp") - F.expr(f"interval {length}"))
    return closed.unionByName(attempts(recent, key, ts, length, slide).where(F.col("window.end") > F.lit(end)))


def _path(spark: SparkSession, name: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(name)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _bases(spark: SparkSession, root: str) -> list[int]:
    """Batches up to which finished base tables go, in order."""
    fs, at = _path(spark, f"{root}/base")
    if not fs.exists(at):
        return []
    found = (f.getPath() for f in fs.listStatus(at))
    whole = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("upto=")) for p in whole)


def _log(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{root}/items")
    except AnalysisException:
        return None


def current_table(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """The item table after the last finished batch (or the last one earlier than ``before``): the newest row of each item."""
    bases = [b for b in _bases(spark, root) if before is None or b < before]
    log = _log(spark, root)
    parts = []
    if bases:
        parts.append(spark.read.parquet(f"{root}/base/upto={bases[-1]}").withColumn("batch", F.lit(bases[-1]).cast("long")))
    if log is not None:
        log = log.withColumn("batch", F.col("batch").cast("long")).where(F.col("batch") > (bases[-1] if bases else -1))
        parts.append(log if before is None else log.where(F.col("batch") < before))
    if not parts:
        return None
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return latest(rows, "item_id", F.col("batch")).drop("batch")


def compact(spark: SparkSession, root: str, upto: int) -> None:
    """Writes a base table of all batches up to ``upto``, and deletes what the base table before it covers.

    What readers of the last base need stays until the next compaction.
    """
    earlier = _bases(spark, root)
    table = current_table(spark, root, upto + 1)
    if table is None or (earlier and earlier[-1] >= upto):
        return
    table.write.mode("overwrite").parquet(f"{root}/base/upto={upto}")
    for old in earlier[:-1]:
        fs, at = _path(spark, f"{root}/base/upto={old}")
        fs.delete(at, True)
    if earlier:
        fs, at = _path(spark, f"{root}/items")
        for f in fs.listStatus(at):
            name = f.getPath().getName()
            if name.startswith("batch=") and int(name.removeprefix("batch=")) <= earlier[-1]:
                fs.delete(f.getPath(), True)


def stream_sync(spark: SparkSession, source: str, root: str, checkpoint: str, every: int = 32, files: int | None = None) -> None:
    """Upserts landed JSON lines into the item table under ``root``: a log of the rows that each batch changed.

    A replayed batch rewrites its own rows from the state before it, so nothing is
    applied twice; a record that came earlier changes nothing more. Every ``every`` batches the log is
    compacted, up to the batch before. ``files`` bounds the files of a batch.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        records = latest(star_records(batch), "item_id", F.col("updated_at"), F.col("starred_at")).withColumn("stars", F.col("stargazers_count"))
        records = hashed(records)
        if batch_id and batch_id % every == 0:
            compact(spark, root, batch_id - 1)
        stored = current_table(spark, root, batch_id)
        if stored is not None:
            met = stored.join(records.select("item_id"), "item_id", "left_semi")
            records = upsert(records, met)
        rows = records.withColumn("batch", F.lit(batch_id).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{root}/items")

    stream = spark.readStream
    if files:
        stream = stream.option("maxFilesPerTrigger", files)
    job = stream.text(source).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()
