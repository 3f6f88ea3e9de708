"""Sources over what the tables are written to first: a log read back from its end, ledgers in SQLite, versions of a table, a stream
of events that come twice."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.session import table, working_path
from lexmill.sources import files, ledger, logs, versions
from lexmill.streaming import ingest


def _written_log(spark: SparkSession, sf_dir: str) -> str:
    """The events as a log of several files in order of time."""
    path = working_path(spark, "event-log")
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), F.concat(F.lit("/u"), "event_id").alias("url"), F.col("user_id").cast("string").alias("proxy_url"))
    files.append_events(events.repartitionByRange(8, "ts", "url").sortWithinPartitions("ts", "url"), path)
    return path


def look_back_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cutoff = datetime(2024, 1, 19, tzinfo=UTC)
    return logs.look_back(spark, _written_log(spark, sf_dir), cutoff, block=1 << 16).select("ts", "kind", "url", F.col("proxy_url").alias("proxy"))


def _written_ledgers(spark: SparkSession, sf_dir: str) -> str:
    path = working_path(spark, "ledgers")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"), "o_totalprice")
    ledger.write_ledgers(orders.repartition(3, "o_custkey"), path, "cases")
    return path


def ledger_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows, and a column that these ledgers lack."""
    return ledger.ledger(spark, _written_ledgers(spark, sf_dir), "cases", "o_orderkey bigint, o_custkey bigint, priority string, o_totalprice double, later string", partitions=4)


def ledger_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQLite leaves of three conditions; the columns they need come along."""
    where = (("priority", "is not null"), ("priority", "in", ["2-HIGH", "3-MEDIUM", "5-LOW"]), ("o_orderkey", ">", 100))
    return ledger.ledger(spark, _written_ledgers(spark, sf_dir), "cases", "o_orderkey bigint, priority string", where, partitions=4)


def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of a table of customers, each made from the one before; an earlier one is still there."""
    path, rows = working_path(spark, "versions"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    for n in range(3):
        old = versions.current(spark, path, n) if n else rows.limit(0)
        versions.publish(old.unionByName(rows.where(F.col("c_custkey") % 3 == n)), path, base=n)
    counts = [versions.current(spark, path, n).groupBy(F.lit(n).alias("version"), "c_nationkey").agg(F.count(F.lit(1)).alias("n")) for n in versions.numbers(spark, path)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def events_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of logs that overlap: the second brings every third event of the first again."""
    root = working_path(spark, "events-twice")
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))
    schema = events.schema
    for n, where in enumerate(("event_id % 2 = 0 OR event_id % 3 = 0", "event_id % 2 = 1 OR event_id % 3 = 0")):
        events.where(where).write.mode("append").option("timestampFormat", files.STAMP).json(f"{root}/in/run={n}")
        stream = spark.readStream.schema(schema).json(f"{root}/in/run=*")
        ingest.appended(stream, "event_id", f"{root}/out", f"{root}/log", late="400 days").awaitTermination()
    return spark.read.schema(schema).parquet(f"{root}/out")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "look_back_scan": look_back_scan,
    "ledger_scan": ledger_scan,
    "ledger_conditions": ledger_conditions,
    "version_history": version_history,
    "events_once": events_once,
}

ORACLE_SQL: dict[str, str] = {
    "look_back_scan": "SELECT ts, event_type AS kind, concat('/u', event_id) AS url, CAST(user_id AS VARCHAR) AS proxy FROM events WHERE ts >= TIMESTAMP '2024-01-19 00:00:00'",
    "ledger_scan": "SELECT o_orderkey, o_custkey, nullif(o_orderpriority, '5-LOW') AS priority, o_totalprice, CAST(NULL AS VARCHAR) AS later FROM orders",
    "ledger_conditions": "SELECT o_orderkey, o_orderpriority AS priority FROM orders WHERE o_orderkey > 100 AND o_orderpriority IN ('2-HIGH', '3-MEDIUM')",
    "version_history": "SELECT CAST(v AS INTEGER) AS version, c_nationkey, count(*) AS n FROM customer, range(1, 4) t(v) WHERE c_custkey % 3 < v GROUP BY 1, 2",
    "events_once": "SELECT event_id, ts, event_type AS kind FROM events",
}
