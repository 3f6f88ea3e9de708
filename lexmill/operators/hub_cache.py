"""Inbound counts of the citation graph kept up to date by deltas of edges, without recounting.

Edges (from_key, to_key) and counts (to_key, inbound) are bucketed states side by side, and version n of the counts counts version n
of the edges.  A delta's new edges are found by the state's buckets (an edge that is there is ignored), committed with the version
they came in (since), and then added to the counts.  If a run ends between the two commits, the next one catches up from since; of
two writers at once one gets a Conflict and has added nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.session import written
from lexmill.sources import buckets, versions


#: Edges that one bucket is meant for, and so one task of a merge.
EDGES = 400_000


def parts_for(edges: int) -> int:
    """Buckets for a cache that is to hold so many edges: a bucket, and with it a task's memory, stays as large as it is."""
    return max(4, -(-edges // EDGES))


def _numbers(spark: SparkSession, path: str) -> tuple[int, int]:
    return tuple(max(versions.numbers(spark, f"{path}/{name}/manifest"), default=0) for name in ("edges", "counts"))


def create(spark: SparkSession, path: str, like: DataFrame, slots: int = 64, parts: int = 64) -> None:
    """An empty cache for edges with the key types of like."""
    edges = like.select("from_key", "to_key", F.lit(0).alias("since")).limit(0)
    buckets.create(edges, f"{path}/edges", ["from_key", "to_key"], slots, parts)
    buckets.create(edges.select("to_key", F.lit(0).cast("bigint").alias("inbound")), f"{path}/counts", ["to_key"], slots, parts)


def _count(spark: SparkSession, path: str, new: DataFrame, base: int) -> None:
    counts = new.groupBy("to_key").agg(F.count(F.lit(1)).alias("inbound"))
    buckets.upsert(spark, f"{path}/counts", written(counts, "hub-delta"), {"inbound": "sum"}, base)


def caught_up(spark: SparkSession, path: str) -> None:
    """Counts what edges hold and counts lack."""
    edges, counts = _numbers(spark, path)
    for n in range(counts + 1, edges + 1):
        _count(spark, path, buckets.state(spark, f"{path}/edges").where(F.col("since") == n), n - 1)


def add(spark: SparkSession, path: str, delta: DataFrame) -> None:
    """Adds a delta of edges: repeated ones and those that are there are ignored; an edge with a null key is none and goes."""
    caught_up(spark, path)
    edges, _ = _numbers(spark, path)
    rows = delta.select("from_key", "to_key").where("from_key IS NOT NULL AND to_key IS NOT NULL")
    once = buckets.dealt(spark, f"{path}/edges", rows).distinct()
    new = written(buckets.absent(spark, f"{path}/edges", once).withColumn("since", F.lit(edges + 1)), "edge-delta")
    buckets.upsert(spark, f"{path}/edges", new, {}, base=edges)
    _count(spark, path, new, edges)


def hubs(spark: SparkSession, path: str) -> DataFrame:
    return buckets.state(spark, f"{path}/counts")
