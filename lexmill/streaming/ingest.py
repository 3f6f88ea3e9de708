"""Incremental work over appended files: windowed kind counts, and snapshots merged into state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.sources import versions


def kind_counts(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts of each kind and window of a stream of (ts, kind); ts without zone is read as UTC."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", window).alias("w"), "kind").count().select(F.col("w.start").alias("start"), "kind", F.col("count").alias("n"))


def ingest(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each run of new rows to merge, with the run's number, and stops when all are read.  After a crash a run may come again,
    with the same number."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_into(stream: DataFrame, state: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Merges each run of new rows into the versioned table at state exactly once: a version names the run that it holds, so a run
    that comes again after its version was committed is passed over, and one that comes again before leaves nothing behind."""

    def once(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = versions.latest(spark, state)
        if last is not None and last.batch is not None and last.batch >= number:
            return
        old = None if last is None else versions.current(spark, state, last.number)
        versions.publish(merge(old, batch), state, base=0 if last is None else last.number, batch=number)

    return ingest(stream, once, checkpoint)


def appended(events: DataFrame, key: str, path: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Appends a stream of events (ts, key and more) to a table at path, each key once: repeats are told apart while they are at most
    so late, and the sink's own log keeps a run that comes again from being added twice."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    return once.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
