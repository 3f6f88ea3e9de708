"""Merges, queues, event statistics, freshness and the citation graph through the library, each with an oracle that states the rule
in its own words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import text
from lexmill.operators import citations, freshness, merge, queues
from lexmill.session import table, views

_COURT = "concat('c', CAST(o_custkey % 12 AS STRING))"
_STATE = f"SELECT {_COURT} AS court, o_orderkey AS number, concat('o', CAST(o_orderkey AS STRING)) AS title, CASE WHEN o_orderkey % 5 = 0 THEN 'tc' ELSE 'en' END AS lang, o_orderkey AS seen, CASE o_orderstatus WHEN 'F' THEN 'downloaded' ELSE 'pending' END AS status, 'html' AS formats FROM orders WHERE o_orderkey % 7 <> 0"
_DELTA = f"SELECT {_COURT} AS court, o_orderkey AS number, CASE WHEN o_orderkey % 9 > 0 THEN concat('n', CAST(o_orderkey AS STRING)) END AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'en' ELSE 'tc' END AS lang, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey + 7 END AS seen, 'doc' AS formats FROM orders WHERE o_orderkey % 3 = 0"
_EDGES = "SELECT l_orderkey AS from_key, l_partkey AS to_key, l_returnflag AS citer_lang, CAST(l_quantity AS INT) AS citer_freq, l_linenumber AS position FROM lineitem"


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    views(spark, sf_dir, "orders")
    return spark.sql(_STATE), spark.sql(_DELTA)


def _upsert(rules: dict[str, str], columns: tuple[str, ...], fresh: str = "pending") -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        state, delta = _both(spark, sf_dir)
        return merge.upsert(state, delta, ["court", "number"], rules).withColumn("status", F.coalesce("status", F.lit(fresh))).select("court", "number", *columns)

    return run


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "lineitem")
    return spark.sql(_EDGES)


def insert_or_ignore_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of even orders are there; of the others the first of each key comes in."""
    key, edges = ["from_key", "to_key", "citer_lang"], _edges(spark, sf_dir)
    state = merge.first_wins(edges.where("from_key % 2 = 0"), key, ["position", "citer_freq"]).withColumn("citer_freq", F.lit(0))
    return merge.insert_or_ignore(state, merge.first_wins(edges, key, ["position", "citer_freq"]), key)


def last_wins_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _edges(spark, sf_dir).groupBy("from_key", "to_key").agg(F.max_by("citer_freq", F.struct("position", "citer_freq")).alias("citer_freq"), F.max("position").alias("position"))
    return rows


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders")
    return spark.sql(f"SELECT {_COURT} AS court, CAST(year(o_orderdate) AS INT) AS yr, o_orderkey AS number, CAST(o_orderdate AS STRING) AS dt, CASE o_orderstatus WHEN 'F' THEN 'downloaded' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 50 END AS pending_stamp FROM orders")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("source"), "event_type", "value", "props")


def inter_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps in seconds between a source's events: how many, their coefficient of variation and spread, and the share over an hour."""
    gap = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(Window.partitionBy("source").orderBy("ts", "event_id")))) / 1e6
    rows = _log(spark, sf_dir).withColumn("gap", gap).groupBy("source").agg(F.count("gap").alias("gaps"), F.round(F.stddev_samp("gap") / F.avg("gap"), 4).alias("cv"), F.round(F.max("gap") - F.min("gap"), 2).alias("spread"), F.round(F.avg((F.col("gap") > 3600).cast("double")), 6).alias("long"))
    return rows.where("gaps >= 2")


def first_in_half_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _log(spark, sf_dir).groupBy("source", F.window("ts", "30 minutes").alias("w")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.select("source", F.col("w.start").alias("start"), "first", "n")


def distinct_last_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _log(spark, sf_dir)
    last = rows.agg(F.max("ts").alias("last"))  # one row
    recent = rows.crossJoin(F.broadcast(last)).where(F.col("ts") >= F.col("last") - F.expr("INTERVAL 240 HOURS"))
    return recent.groupBy("source").agg(F.count_distinct("props").alias("distinct_props"), F.count(F.lit(1)).alias("n")).where("distinct_props * 2 > n")


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return _log(spark, sf_dir).groupBy("event_type").agg(F.round(F.median(v), 4).alias("median"), F.round(F.min(v), 4).alias("least"), F.round(F.max(v), 4).alias("most"), F.round(F.avg(v), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 4).alias("sd"))


def failure_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 20 challenges and 5 failures of each signature; bodies are cut at 200 KiB."""
    views(spark, sf_dir, "documents")
    rows = spark.sql("SELECT doc_id, text, CASE WHEN doc_id % 4 = 0 THEN 'challenge' ELSE concat('..HTTP 50', doc_id % 3, '/', source) END AS said FROM documents")
    rows = rows.select("doc_id", text.signature(F.col("said")).alias("signature"), F.length(F.substring("text", 1, 204_800)).alias("kept"))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("signature").orderBy("doc_id")))
    return ranked.where(F.col("n") <= F.when(F.col("signature") == "challenge", 20).otherwise(5)).drop("n")


_BUCKETS = """SELECT 'cases' AS kind, concat('s', CAST(o_orderkey AS STRING)) AS scope, 'en' AS lang, CASE WHEN o_orderkey % 11 = 0 THEN 'timeout' END AS probe_error, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 3 END AS live_count,
    CASE WHEN o_orderkey % 6 > 0 THEN o_orderkey % 2 END AS local_count, CASE o_orderkey % 5 WHEN 0 THEN '2020-01-01' WHEN 1 THEN '2020-01-02' WHEN 2 THEN 'soon' WHEN 3 THEN '2020-01-03' END AS live_updated_at,
    1577900000 + o_orderkey % 1000 AS live_probed_at, CASE WHEN o_orderkey % 13 > 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 1577894399 ELSE 1577900500 END END AS last_scrape_completed_at FROM orders"""


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders")
    return spark.sql(_BUCKETS)


def fresh_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _buckets(spark, sf_dir).select("scope", freshness.fresh().alias("fresh"), freshness.stale_reason().alias("reason"))


def freshness_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _buckets(spark, sf_dir)
    return freshness.summary(rows.where("scope not like '%7'"), rows.select("kind", "scope", "lang"))


def format_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted union of old and new formats, and what was saved without the document and with it."""
    views(spark, sf_dir, "orders")
    rows = spark.sql("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN array('txt', 'doc') ELSE array('html') END AS old, CASE WHEN o_orderkey % 3 = 0 THEN array('json', 'doc') ELSE array('txt', 'html') END AS new FROM orders")
    joined = lambda c: F.array_join(c, ",")
    return rows.select("o_orderkey", joined(F.array_sort(F.array_union("old", "new"))).alias("both"), joined(F.array_remove("new", "doc")).alias("pages"), joined(F.array_union(F.array_remove("new", "doc"), F.array(F.lit("doc")))).alias("saved"))


def caps_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "part")
    return citations.caps(spark.sql("SELECT CAST(p_partkey AS STRING) AS parent_cap, concat(p_partkey + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END, CASE WHEN p_partkey % 3 > 0 THEN 'AB' ELSE '' END) AS child_cap FROM part"))


def appeal_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "conversations")
    body = "to_json(transform(sort_array(collect_list(struct(turn, role))), x -> named_struct('caseno', concat(x.role, x.turn), 'date', '2001-01-01')))"
    return citations.appeal_chain(spark.sql(f"SELECT conv_id, {body} AS body FROM conversations GROUP BY conv_id"))


def canonical_cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders", "part")
    return citations.canonical(spark.sql("SELECT o_orderkey, concat('p', o_custkey) AS cite FROM orders"), spark.sql("SELECT concat('p', p_partkey) AS parallel_cite, concat('k', p_partkey % 10) AS case_key FROM part UNION ALL SELECT concat('p', p_partkey), 'z' FROM part"))


def authority_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "part")
    inbound = citations.hubs(_edges(spark, sf_dir)).withColumnRenamed("to_key", "p_partkey")
    rows = spark.sql("SELECT p_partkey, CAST(p_size AS DOUBLE) / 50 AS similarity, CASE p_size % 3 WHEN 0 THEN 1.0D WHEN 1 THEN 0.5D ELSE 0.0D END AS court, CAST(p_partkey % 40 AS DOUBLE) AS years FROM part").join(inbound, "p_partkey", "left")
    return rows.select("p_partkey", F.round(citations.authority(F.col("similarity"), F.coalesce("inbound", F.lit(0)), F.col("court"), F.col("years")), 6).alias("score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "upsert_case_merge": _upsert({"title": "new", "lang": "english_wins", "seen": "new"}, ("title", "lang", "seen", "status")),
    "upsert_downloaded_merge": _upsert({"title": "new", "lang": "english_wins", "seen": "new", "formats": "new"}, ("status", "formats", "lang"), "downloaded"),
    "upsert_coalesce_merge": _upsert({"title": "new", "seen": "new"}, ("title", "seen")),
    "recheck_queue": lambda spark, sf_dir: queues.recheck_queue(_cases(spark, sf_dir)).select("court", "number", "pending_stamp"),
    "pending_cases": lambda spark, sf_dir: queues.pending_cases(_cases(spark, sf_dir)).select("court", "yr", "number"),
    "claim_batch": lambda spark, sf_dir: queues.claim_batch(_cases(spark, sf_dir)).select("court", "number", "status"),
    "hub_cases": lambda spark, sf_dir: citations.hubs(_edges(spark, sf_dir), None, 20, 20),
    "hubs_of_court": lambda spark, sf_dir: citations.hubs(_edges(spark, sf_dir).withColumn("to_key", F.concat(F.when(F.col("to_key") % 2 == 0, "hkca").otherwise("hkdc"), F.lit("/"), F.col("to_key").cast("string"))), "hkca"),
    "shared_partners": lambda spark, sf_dir: citations.partner_counts(_edges(spark, sf_dir)),
    **{f.__name__: f for f in (insert_or_ignore_edges, last_wins_batch, inter_arrival, first_in_half_hour, distinct_last_hours, latency, failure_samples, fresh_rule, freshness_totals, format_sets, caps_by_suffix, appeal_steps, canonical_cites, authority_rank)},
}

_MERGED = f"WITH s AS ({_STATE}), d AS ({_DELTA}), m AS (SELECT coalesce(s.court, d.court) AS court, coalesce(s.number, d.number) AS number, s.title AS st, d.title AS dt, s.lang AS sl, d.lang AS dl, s.seen AS ss, d.seen AS ds, s.status AS status, s.formats AS sf, d.formats AS df FROM s FULL JOIN d ON s.number = d.number)"
_LANG = "CASE WHEN 'en' IN (coalesce(sl, ''), coalesce(dl, '')) THEN 'en' ELSE coalesce(dl, sl) END AS lang"
_K = "coalesce(try_cast(live_updated_at AS DATE) < sd OR (try_cast(live_updated_at AS DATE) = sd AND live_probed_at <= last_scrape_completed_at), false)"
_B = f"SELECT *, CAST(to_timestamp(last_scrape_completed_at + 28800) AT TIME ZONE 'UTC' AS DATE) AS sd FROM ({_BUCKETS}) b"
_F = f"coalesce(probe_error IS NULL AND live_count = local_count, false) AND {_K}"
ORACLE_SQL: dict[str, str] = {
    "upsert_case_merge": f"{_MERGED} SELECT court, number, coalesce(dt, st) AS title, {_LANG}, coalesce(ds, ss) AS seen, coalesce(status, 'pending') AS status FROM m",
    "upsert_downloaded_merge": f"{_MERGED} SELECT court, number, coalesce(status, 'downloaded') AS status, coalesce(df, sf) AS formats, {_LANG} FROM m",
    "upsert_coalesce_merge": f"{_MERGED} SELECT court, number, coalesce(dt, st) AS title, coalesce(ds, ss) AS seen FROM m",
    "recheck_queue": f"SELECT {_COURT} AS court, o_orderkey AS number, o_orderkey % 50 AS pending_stamp FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0",
    "pending_cases": f"SELECT {_COURT} AS court, CAST(year(o_orderdate) AS INT) AS yr, o_orderkey AS number FROM orders WHERE o_orderstatus <> 'F'",
    "claim_batch": f"SELECT {_COURT} AS court, o_orderkey AS number, 'in_progress' AS status FROM orders WHERE o_orderstatus <> 'F'",
    "hub_cases": "SELECT l_partkey AS to_key, count(DISTINCT l_orderkey) AS inbound FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) >= 20 ORDER BY inbound DESC, to_key LIMIT 20",
    "hubs_of_court": "SELECT concat('hkca/', l_partkey) AS to_key, count(DISTINCT l_orderkey) AS inbound FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY l_partkey",
    "shared_partners": "SELECT DISTINCT e.l_orderkey AS from_key, e.l_partkey AS to_key, n - 1 AS partners FROM lineitem e JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_orderkey) c ON c.l_orderkey = e.l_orderkey WHERE n > 1",
    "insert_or_ignore_edges": "SELECT from_key, to_key, citer_lang, CASE WHEN from_key % 2 = 0 THEN 0 ELSE citer_freq END AS citer_freq, position FROM (SELECT l_orderkey AS from_key, l_partkey AS to_key, l_returnflag AS citer_lang, arg_min(CAST(l_quantity AS INT), (l_linenumber, CAST(l_quantity AS INT))) AS citer_freq, min(l_linenumber) AS position FROM lineitem GROUP BY ALL) t",
    "last_wins_batch": "SELECT l_orderkey AS from_key, l_partkey AS to_key, arg_max(CAST(l_quantity AS INT), (l_linenumber, CAST(l_quantity AS INT))) AS citer_freq, max(l_linenumber) AS position FROM lineitem GROUP BY ALL",
    "inter_arrival": "SELECT user_id AS source, count(gap) AS gaps, round(stddev_samp(gap) / avg(gap), 4) AS cv, round(max(gap) - min(gap), 2) AS spread, round(avg(CASE WHEN gap > 3600 THEN 1.0::DOUBLE WHEN gap IS NOT NULL THEN 0 END), 6) AS long FROM (SELECT user_id, epoch_us(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6::DOUBLE AS gap FROM (SELECT user_id, event_id, ts FROM events) e) t GROUP BY user_id HAVING count(gap) >= 2",
    "first_in_half_hour": "SELECT user_id AS source, time_bucket(INTERVAL 30 MINUTES, ts, TIMESTAMP '1970-01-01') AS start, arg_min(event_id, (ts, event_id)) AS first, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1",
    "distinct_last_hours": "SELECT user_id AS source, count(DISTINCT props) AS distinct_props, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 240 HOURS GROUP BY user_id HAVING count(DISTINCT props) * 2 > count(*)",
    "latency": "SELECT event_type, round(median(value), 4) AS median, round(min(value), 4) AS least, round(max(value), 4) AS most, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS sd FROM events GROUP BY event_type",
    "failure_samples": "SELECT doc_id, signature, least(length(text), 204800) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY doc_id) AS n FROM (SELECT doc_id, text, CASE WHEN doc_id % 4 = 0 THEN 'challenge' ELSE concat('HTTP_50', doc_id % 3, '_', source) END AS signature FROM documents) t) u WHERE n <= CASE WHEN signature = 'challenge' THEN 20 ELSE 5 END",
    "fresh_rule": f"SELECT scope, {_F} AS fresh, CASE WHEN probe_error IS NOT NULL THEN 'probe error' WHEN live_count IS NULL THEN 'no live count' WHEN local_count IS NULL THEN 'no local count' WHEN live_count <> local_count THEN 'counts differ' WHEN sd IS NULL THEN 'never scraped' WHEN live_updated_at IS NULL THEN 'no live date' WHEN live_updated_at > CAST(sd AS VARCHAR) THEN 'updated since' ELSE 'fresh' END AS reason FROM ({_B}) t",
    "freshness_totals": f"SELECT count(*) FILTER (WHERE here) AS probed, count(*) FILTER (WHERE here AND probe_error IS NULL) AS healthy, count(*) FILTER (WHERE here AND {_F}) AS fresh, count(*) FILTER (WHERE here AND NOT ({_F})) AS stale, count(*) FILTER (WHERE NOT here) AS first_run FROM (SELECT *, scope NOT LIKE '%7' AS here FROM ({_B}) b) t",
    "format_sets": "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'doc,json,txt' WHEN 3 THEN 'doc,html,json' WHEN 1 THEN 'html,txt' WHEN 5 THEN 'html,txt' ELSE 'doc,html,txt' END AS both, CASE WHEN o_orderkey % 3 = 0 THEN 'json' ELSE 'txt,html' END AS pages, CASE WHEN o_orderkey % 3 = 0 THEN 'json,doc' ELSE 'txt,html,doc' END AS saved FROM orders",
    "caps_by_suffix": "SELECT CAST(p_partkey AS VARCHAR) AS parent, concat(p_partkey + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END, CASE WHEN p_partkey % 3 > 0 THEN 'AB' ELSE '' END) AS child, p_partkey % 5 > 0 AND p_partkey % 3 > 0 AS derived FROM part",
    "appeal_steps": "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS INT) AS step, concat(role, turn) AS caseno, '2001-01-01' AS date FROM conversations",
    "canonical_cites": "SELECT concat('p', o_custkey) AS cite, o_orderkey, CASE WHEN p_partkey IS NULL THEN concat('p', o_custkey) ELSE concat('k', p_partkey % 10) END AS case_key FROM orders LEFT JOIN part ON p_partkey = o_custkey",
    "authority_rank": "SELECT p_partkey, round(p_size / 50.0::DOUBLE + 0.1 * ln(1 + coalesce(n, 0)) + 0.2 * CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0 END + 0.1 * exp(-0.05 * (p_partkey % 40)), 6) AS score FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_partkey) c ON l_partkey = p_partkey",
}
