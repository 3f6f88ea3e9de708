"""The monitor: what a run's ledger, events and log say about its health.  Tables are aggregated in Spark; what the rules look at
afterwards are a few rows."""

from __future__ import annotations

from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import scalars

#: Kinds that are always shown, in order, and the thresholds of the rules.
KINDS = ("request_success", "request_failed", "warmup", "challenge_detected", "pool_exhausted", "degraded")
PREFIX_CRITICAL, PREFIX_WARN, WORKER_FACTOR, RATE_CRITICAL, RATE_WARN, RATE_HOURS = 100, 20, 4, 4000, 6000, 1.0
LEVELS = ("HEALTHY", "WARN", "CRITICAL")
_ALERT = "level string, rule string, subject string, n double"


def window(events: DataFrame, now, minutes: int) -> DataFrame:
    """Events (ts, kind, proxy, url) of the last minutes."""
    return events.where(F.col("ts") >= F.lit(now) - F.expr(f"INTERVAL {int(minutes)} MINUTES"))


def kind_counts(events: DataFrame) -> DataFrame:
    """(kind, n, place): the kinds that are always shown, zero if there are none, and then all others."""
    shown = events.sparkSession.createDataFrame([(k, i) for i, k in enumerate(KINDS)], "kind string, place int")
    counts = events.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(shown, "kind", "full_outer").select("kind", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), F.coalesce("place", F.lit(len(KINDS))).alias("place"))


def hotspots(events: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """(proxy, failed, mean, threshold) of proxies whose failures and challenges exceed the pool's mean by so many deviations.  The
    pool are proxies with a request; of fewer than two, or without deviation, none is hot."""
    served = events.where(F.col("kind").isin("request_success", "request_failed", "challenge_detected") & F.col("proxy").isNotNull())
    pool = served.groupBy("proxy").agg(F.count_if(F.col("kind") != "request_success").alias("failed"))
    whole = pool.agg(F.count(F.lit(1)).alias("n"), F.avg("failed").alias("mean"), F.stddev_pop("failed").alias("sigma"))  # one row
    rows = pool.crossJoin(F.broadcast(whole)).where((F.col("n") >= 2) & (F.col("sigma") > 0) & (F.col("failed") > F.col("mean") + sigmas * F.col("sigma")))
    return rows.select("proxy", "failed", F.round("mean", 1).alias("mean"), F.round(F.col("mean") + sigmas * F.col("sigma"), 1).alias("threshold"))


def recent_challenges(events: DataFrame, n: int = 5) -> DataFrame:
    return events.where("kind = 'challenge_detected'").orderBy(F.desc("ts"), "url").select("ts", "url", "proxy").limit(n)


def recent_warnings(lines: DataFrame, tail: int = 200, n: int = 5) -> DataFrame:
    """lines (position, line) of a log: the last n warnings among its last lines, as (position, said), oldest first."""
    last = lines.orderBy(F.desc("position")).limit(tail)
    return last.select("position", scalars.log_warning(F.col("line")).alias("said")).where("said is not null").orderBy(F.desc("position")).limit(n).orderBy("position")


def progress(cases: DataFrame, now: int, file_time: int) -> DataFrame:
    """One row: total, downloaded, in_progress, failed, pending, run_start (the first stamp of a case, else the ledger's own time, and
    which), hours since, downloads an hour and the hours that the rest needs (null where there is no rate)."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    row = cases.agg(F.count(F.lit(1)).alias("total"), *map(count, ("downloaded", "in_progress", "failed", "pending")), F.min("last_seen").alias("first"))
    row = row.withColumns({"run_start": F.coalesce("first", F.lit(file_time)), "source": F.when(F.col("first").isNull(), "ledger").otherwise("cases")})
    row = row.withColumn("hours", (F.lit(now) - F.col("run_start")) / 3600.0)
    row = row.withColumn("per_hour", F.when(F.col("hours") > 0, F.col("downloaded") / F.col("hours")))
    return row.withColumn("eta_hours", F.when(F.col("per_hour") > 0, (F.col("pending") + F.col("in_progress")) / F.col("per_hour"))).drop("first")


def error_prefixes(cases: DataFrame, length: int = 40, n: int = 5) -> DataFrame:
    """(prefix, n) of the commonest beginnings of failed cases' errors; of a null one, which takes a place, nothing is shown."""
    counts = cases.where("status = 'failed'").groupBy(F.substring("error", 1, length).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "prefix").limit(n).where("prefix is not null")


def alerts(state: DataFrame, prefixes: DataFrame, kinds: DataFrame | None, hot: DataFrame | None, workers: int = 20) -> DataFrame:
    """(level, rule, subject, n) of the six rules, each over a few rows: failures of one kind, cases that are stuck, the rate, and, if
    there are events, degraded checks, exhausted pools and hot proxies."""
    crowded = prefixes.where(F.col("n") >= PREFIX_WARN).select(F.when(F.col("n") > PREFIX_CRITICAL, "CRITICAL").otherwise("WARN").alias("level"), F.lit("error_prefix").alias("rule"), F.col("prefix").alias("subject"), F.col("n").cast("double").alias("n"))
    stuck = state.where(F.col("in_progress") > WORKER_FACTOR * workers).select(F.lit("CRITICAL").alias("level"), F.lit("in_progress").alias("rule"), F.lit("").alias("subject"), F.col("in_progress").cast("double").alias("n"))
    slow = state.where((F.col("hours") > RATE_HOURS) & (F.col("per_hour") <= RATE_WARN)).select(F.when(F.col("per_hour") < RATE_CRITICAL, "CRITICAL").otherwise("WARN").alias("level"), F.lit("rate").alias("rule"), F.lit("").alias("subject"), F.col("per_hour").alias("n"))
    rules = [crowded, stuck, slow]
    if kinds is not None:
        rules.append(kinds.where(F.col("kind").isin("degraded", "pool_exhausted") & (F.col("n") > 0)).select(F.lit("WARN").alias("level"), F.col("kind").alias("rule"), F.lit("").alias("subject"), F.col("n").cast("double").alias("n")))
    if hot is not None:
        rules.append(hot.select(F.lit("WARN").alias("level"), F.lit("hotspot").alias("rule"), F.col("proxy").cast("string").alias("subject"), F.col("failed").cast("double").alias("n")))
    return reduce(DataFrame.unionByName, rules)


def severity(found: DataFrame) -> str:
    rank = found.agg(F.max(F.when(F.col("level") == "CRITICAL", 2).otherwise(1)).alias("r")).first().r
    return LEVELS[rank or 0]


def exit_code(level: str) -> int:
    return LEVELS.index(level)


def render(cases: DataFrame, events: DataFrame | None, lines: DataFrame | None, now: datetime, file_time: int, minutes: int = 30, workers: int = 20) -> tuple[str, str]:
    """The level, and the report as text: status counts, error prefixes, event kinds, hot proxies, warnings."""
    state, prefixes = progress(cases, int(now.replace(tzinfo=now.tzinfo or UTC).timestamp()), file_time), error_prefixes(cases)
    lately = None if events is None else window(events, now, minutes)
    kinds, hot = (None, None) if lately is None else (kind_counts(lately), hotspots(lately))
    found = alerts(state, prefixes, kinds, hot, workers)
    level, row = severity(found), state.first()
    out = [f"[{level}]", f"{'status':<14} {'count':>7}", *(f"{k:<14} {row[k]:>7}" for k in ("downloaded", "in_progress", "failed", "pending")), "top error prefixes"]
    out += [f"  {r.prefix:<40} {r.n:>5}" for r in prefixes.collect()] or ["  (none)"]
    out += [f"recent events (last {minutes} min)"]
    out += ["  N/A"] if kinds is None else [f"  {r.kind:<22} {r.n:>6}" for r in kinds.orderBy("place", "kind").collect()]
    out += ["hot proxies"]
    out += ["  N/A"] if hot is None else [f"  {r.proxy:<30} failed={r.failed}" for r in hot.orderBy(F.desc("failed"), "proxy").collect()] or ["  (none)"]
    out += ["last warnings"]
    out += ["  (no log)"] if lines is None else [f"  {r.said}" for r in recent_warnings(lines).collect()] or ["  (none)"]
    return level, "\n".join(out)
