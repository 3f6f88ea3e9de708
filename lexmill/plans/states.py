"""The ledger's operators on a ledger made of orders: validator, queues, marks, counts, monitor, plans, outcomes and sinks.

`LEDGER` and the other tables are data alone; what the operators make of them the oracle states anew, from the keys."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import marks, monitor, planning, queues, stats, validator
from lexmill.session import views, working_path, written
from lexmill.sources import sinks, versions

_COURT = "concat('hk', CASE o_custkey % 4 WHEN 0 THEN 'cfi' WHEN 1 THEN 'ca' WHEN 2 THEN 'cfa' ELSE 'dc' END)"
_YEAR = "CAST(year(o_orderdate) AS INT)"
LEDGER = f"""SELECT {_COURT} AS court, {_YEAR} AS year, o_orderkey AS number, CASE o_orderkey % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'failed' ELSE 'downloaded' END AS status,
    concat('[2001] HKX ', CAST(o_orderkey AS STRING)) AS neutral, CASE o_orderkey % 3 WHEN 0 THEN 'doc' WHEN 1 THEN 'html,json,txt' ELSE 'doc,html' END AS formats_text,
    CASE WHEN o_orderkey % 7 = 2 THEN concat('HTTP ', CAST(500 + o_custkey % 5 AS STRING), ': no') END AS error, CASE WHEN o_orderkey % 11 > 0 THEN 1000 + o_orderkey END AS last_seen,
    CASE WHEN o_orderkey % 5 = 0 THEN 2000 - o_orderkey % 100 END AS html_pending, CASE WHEN o_orderkey % 12 = 3 THEN '.doc' END AS html_from, CASE WHEN o_orderkey % 12 = 6 THEN 'tool failed' END AS html_error,
    CASE o_orderkey % 5 WHEN 0 THEN 'downloaded' WHEN 1 THEN 'na' WHEN 2 THEN 'failed' ELSE 'pending' END AS summary_en_status, CASE WHEN o_orderkey % 5 = 2 THEN 'bad' END AS summary_en_error,
    'pending' AS summary_zh_status, CAST(NULL AS STRING) AS summary_zh_error, CASE o_orderkey % 4 WHEN 0 THEN 'downloaded' ELSE 'pending' END AS appeal_history_status, CAST(NULL AS STRING) AS appeal_history_error,
    CAST(o_orderdate AS STRING) AS dt, CASE WHEN o_orderkey % 6 = 0 THEN 'tc' ELSE 'en' END AS lang, o_custkey AS custkey FROM orders"""
_C = f"WITH c AS ({LEDGER}), d AS (SELECT *, number AS k, concat(court, '/', CAST(year AS STRING), '/') AS folder, concat(court, '_', CAST(year AS STRING), '_', CAST(number AS STRING)) AS stem FROM c WHERE status = 'downloaded')"
#: Files: pages (some missing, some empty, some challenges), texts, documents (some of another kind), summaries, misplaced and odd ones.
_FILES = f"""{_C}
    SELECT concat(folder, stem, '.html') AS path, CASE WHEN k % 10 = 2 THEN 0 ELSE 100 END AS size, '' AS head, CASE WHEN k % 9 = 0 THEN '<p>Just a MOMENT...' ELSE concat('<p>see [2001]  hkx ', CAST(k AS STRING)) END AS body, k AS mtime FROM d WHERE k % 3 > 0 AND k % 10 <> 1
    UNION ALL SELECT concat(folder, stem, '.txt'), 50, '', CASE WHEN k % 8 = 0 THEN 'nothing' ELSE concat('A [2001] HKX   ', CAST(k AS STRING), ' b') END, k FROM d WHERE k % 3 = 1 AND k % 20 <> 3
    UNION ALL SELECT concat(folder, stem, '.json'), 50, '', '{{}}', k FROM d WHERE k % 3 = 1
    UNION ALL SELECT concat(folder, stem, CASE k % 4 WHEN 0 THEN '.docx' WHEN 1 THEN '.rtf' ELSE '.doc' END), 50, CASE WHEN k % 13 = 0 THEN '00000000' WHEN k % 4 = 0 OR k % 17 = 0 THEN '504B0304' WHEN k % 4 = 1 THEN '7B5C7274' ELSE 'D0CF11E0' END, '', k FROM d WHERE k % 3 <> 1 AND k % 15 <> 0
    UNION ALL SELECT concat(folder, stem, '.summary_en.html'), 10, '', CASE WHEN k % 30 = 0 THEN '系統維護' ELSE 'fine' END, k FROM d WHERE k % 5 = 0 AND k % 25 <> 0 OR k % 5 = 3 AND k % 50 = 3
    UNION ALL SELECT concat(court, '/', CAST(year + 1 AS STRING), '/', stem, '.json'), 10, '', '', k FROM d WHERE k % 50 = 7
    UNION ALL SELECT concat('hkcfi/2000/note', CAST(k AS STRING), '.json'), 10, '', '', k FROM d WHERE k % 40 = 4
    UNION ALL SELECT concat('other/2000/x', CAST(k AS STRING), '.json'), 10, '', '', k FROM d WHERE k % 40 = 5"""
RUN_START = 700


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders")
    return spark.sql(LEDGER).withColumn("formats", F.split("formats_text", ",")).drop("formats_text")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders")
    return spark.sql(_FILES.replace("{{}}", "{}")).withColumn("head", F.unhex("head"))


def _check(check: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: check(_ledger(spark, sf_dir), _files(spark, sf_dir)).select("level", "court", "year", "number", "path", "expected", "observed")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validator.validate(_ledger(spark, sf_dir), _files(spark, sf_dir))


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("formats", F.array_join("formats", ","))


def _hit(spark: SparkSession, sf_dir: str, where: str, *columns) -> DataFrame:
    return _ledger(spark, sf_dir).where(where).select("court", "year", "number", *columns)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "region")
    return spark.sql("""SELECT r_regionkey AS generation, 100 * r_regionkey AS started_at, CASE WHEN r_regionkey % 4 < 3 THEN 100 * r_regionkey + 50 END AS completed_at, array('hkca', 'hkcfi') AS courts, array('en', 'tc') AS langs,
        CASE WHEN r_regionkey = 2 OR r_regionkey = 4 THEN '01/01/2020' END AS min_date, CAST(NULL AS STRING) AS max_date FROM region""")  # fmt: skip


_FRESH = "SELECT 'cases' AS kind, concat('s', CAST(n_nationkey AS STRING)) AS scope, 'en' AS lang, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey % 4 END AS live_count, '2020-01-01' AS live_updated_at, 5 AS live_probed_at, CASE WHEN n_nationkey % 5 = 0 THEN 'old' END AS probe_error, n_nationkey % 2 AS local_count, 6 AS local_count_at, 7 AS last_scrape_completed_at, 1 AS generation, n_nationkey AS n FROM nation"


def freshness_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes of even scopes, counts of every third and scrapes of every fourth, and a probe of a new scope."""
    views(spark, sf_dir, "nation")
    state = spark.sql(_FRESH)
    of = lambda where, *cols: state.where(where).select("kind", "scope", "lang", *(F.expr(c) for c in cols))
    probes = of("n % 2 = 0", "CASE WHEN n % 4 = 0 THEN 99 END AS live_count", "CAST(NULL AS STRING) AS live_updated_at", "50 AS live_probed_at", "CASE WHEN n % 4 > 0 THEN 'new' END AS probe_error")
    probes = probes.unionByName(spark.sql("SELECT 'cases' AS kind, 'fresh' AS scope, 'en' AS lang, 3 AS live_count, '2021-01-01' AS live_updated_at, 50 AS live_probed_at, CAST(NULL AS STRING) AS probe_error"))
    out = marks.freshness_probe(state.drop("n"), probes)
    out = marks.freshness_local(out, of("n % 3 = 0", "n AS local_count", "60 AS local_count_at"))
    return marks.freshness_scraped(out, of("n % 4 = 0", "70 AS last_scrape_completed_at", "CAST(NULL AS INT) AS generation"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "events")
    return spark.sql("SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, CASE event_type WHEN 'view' THEN 'request_success' WHEN 'error' THEN 'request_failed' WHEN 'purchase' THEN 'challenge_detected' WHEN 'click' THEN 'warmup' ELSE 'odd' END AS kind, CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 5 = 0 THEN 1 ELSE user_id END AS proxy, concat('/u', event_id) AS url FROM events")


def _document(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "documents")
    return spark.sql("""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN ' ' WHEN doc_id % 11 = 0 THEN 'Just a moment...' ELSE 'page' END AS content, CASE WHEN doc_id % 4 > 0 THEN 'u' END AS doc_url, unhex(CASE doc_id % 5 WHEN 0 THEN '504B0304' WHEN 1 THEN '00' WHEN 2 THEN NULL ELSE '7B5C7274' END) AS head,
        CASE WHEN doc_id % 3 = 0 THEN array('html', 'txt') ELSE array('html', 'doc') END AS formats, CASE WHEN doc_id % 8 = 0 THEN 500 ELSE 200 END AS status FROM documents""")  # fmt: skip


def download_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.download_outcome(_document(spark, sf_dir)).select("doc_id", "outcome", F.array_join("saved", ",").alias("saved"), "html_later")


def recheck_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.recheck_outcome(_document(spark, sf_dir).withColumn("old", F.array(F.lit("doc"), F.lit("json")))).select("doc_id", "outcome", F.array_join("formats", ",").alias("formats"))


def summary_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _document(spark, sf_dir)
    state, error = planning.summary_outcome(F.col("doc_url"), F.col("content"), F.when(F.col("status") == 500, "HTTP 500"))
    return rows.select("doc_id", state.alias("state"), error.alias("error"))


def conversion_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document(spark, sf_dir).select("doc_id", planning.conversion_route(F.col("head")).alias("tool"))


def plan_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.Plan("weekly", {"recent_days": 10, "include_ukpc": False}).rows(spark, date(2026, 3, 4)).select("place", "step", F.get_json_object("settings", "$.min_date").alias("min_date"), F.get_json_object("settings", "$.max_date").alias("max_date"))


def orphan_guard_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    said = [("whole", *planning.orphan_guard(runs, ["hkca", "hkcfi"], ["en"])), ("more", *planning.orphan_guard(runs, ["hkca", "hkdc"], ["en", "sc"])), ("none", *planning.orphan_guard(runs.where("generation = 2"), ["hkca"], ["en"]))]
    return spark.createDataFrame(said, "wanted string, cutoff bigint, why string")


def coverage_canary(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders")
    probes = spark.sql(f"SELECT court, lang, CASE WHEN court <> 'hkdc' THEN count(*) END AS live FROM ({LEDGER}) GROUP BY court, lang")
    return planning.canary(_ledger(spark, sf_dir), probes, 5, most=4)


def freshness_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "nation")
    matrix = spark.sql("SELECT concat('s', n_nationkey) AS slug, CASE WHEN n_nationkey % 2 = 0 THEN array('en', 'tc') ELSE array('en') END AS langs FROM nation")
    ledger = spark.sql(f"SELECT kind, scope, lang, live_count, local_count, live_updated_at FROM ({_FRESH}) UNION ALL SELECT 'hopt', scope, lang, 1000, 1000, 'x' FROM ({_FRESH}) WHERE n % 3 = 0 UNION ALL SELECT 'hopt', scope, 'tc', 8, 9, NULL FROM ({_FRESH}) WHERE n % 4 < 2")
    return planning.report(matrix, ledger, ("en", "tc"))


def fresh_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "nation")
    ledger = spark.sql("SELECT n_nationkey AS scope, lang, n_nationkey % 3 > 0 OR lang = 'en' AND n_nationkey % 2 = 0 AS fresh FROM nation, (SELECT explode(array('en', 'tc')) AS lang) WHERE NOT (n_nationkey % 5 = 0 AND lang = 'tc')")
    return planning.fresh_scopes_dropped(spark.sql("SELECT n_nationkey AS scope FROM nation"), ledger, ["en", "tc"])


def simulated_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "nation")
    return planning.simulated(spark.sql(_FRESH), 1234).select("scope", "last_scrape_completed_at")


def judgment_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of judgments, published and read again."""
    views(spark, sf_dir, "documents")
    rows = spark.sql("""SELECT 'hkca' AS court, 2001 AS year, doc_id AS number, lang, CASE WHEN doc_id % 2 = 0 THEN array('html') ELSE array('txt', 'html', 'json') END AS formats, concat('<p>', doc_id, '</p> <br>end') AS content,
        coalesce(source, '') AS title, '' AS case_number, '' AS court_name, '' AS date, '' AS neutral, array() AS parallel, CAST(NULL AS STRING) AS doc_url, false AS has_translation FROM documents""")  # fmt: skip
    path = working_path(spark, "judgments")
    version = versions.publish(sinks.judgment_files(rows, "https://example.org", translation=True), path)
    out = versions.current(spark, path, version.number)
    return out.select("path", F.when(F.col("path").endswith(".json"), F.get_json_object("content", "$.url")).otherwise(F.col("content")).alias("said"))


def document_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of statutes, treaties, privy-council cases, enrichment and raw snapshots."""
    views(spark, sf_dir, "documents")
    base = spark.sql("SELECT doc_id AS num, CASE WHEN doc_id % 2 = 0 THEN 'tc' ELSE 'en' END AS lang, CASE WHEN doc_id % 3 > 0 THEN concat('c', doc_id) END AS c FROM documents")
    statutes = sinks.statute_files(base.select(F.lit("cap").alias("abbr"), "num", "lang", F.lit("[]").alias("versions"), F.col("c").alias("content")))[0]
    treaties = sinks.treaty_files(base.select(F.lit("hkts").alias("abbr"), F.lit("nd").alias("year"), "num", "lang", F.lit("{}").alias("metadata"), F.col("c").cast("binary").alias("pdf"), F.when(F.col("num") % 5 == 0, "text").alias("extracted"))).select("path", F.coalesce("content", F.col("bytes").cast("string")).alias("content"))
    privy = sinks.privy_files(base.select(F.lit("ukpc").alias("abbr"), F.lit(1990).alias("year"), "num", "lang", F.lit("<p>a</p>b").alias("content")))
    added = sinks.enrichment_files(base.select(F.lit("hkca").alias("court"), F.lit(2000).alias("year"), F.col("num").alias("number"), F.when(F.col("lang") == "tc", "zh").otherwise("en").alias("lang"), F.when(F.col("num") % 2 == 0, "summary").otherwise("history").alias("kind"), F.lit("b").alias("body")))
    raw = sinks.snapshot_files(base.select("num", F.lit("[1]").alias("body")), "noteup", F.col("num").cast("string"))
    return statutes.unionByName(treaties).unionByName(privy).unionByName(added).unionByName(raw)


def merged_decision_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "supplier")
    rows = spark.sql("SELECT 2001 AS year, s_suppkey AS num, 'en' AS lang, named_struct('title', s_name) AS listed, named_struct('filename', concat('f', s_suppkey)) AS published FROM supplier")
    return sinks.merged_decisions(rows, ("listed", "published"))


def event_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "events")
    lines = spark.sql("SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{broken' WHEN 1 THEN '{\"kind\":\"warmup\",\"proxy\":\"p\"}' WHEN 2 THEN '{\"kind\":\"warmup\",\"extra_1\":1}' WHEN 3 THEN '{\"kind\":\"strange\"}' WHEN 4 THEN '{\"kind\":\"request_failed\",\"url\":\"u\"}' ELSE '[1]' END AS line FROM events")
    return stats.event_faults(lines, ["ts", "kind", "url", "proxy", "elapsed_ms", "error_class"])


def header_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "events")
    rows = spark.sql("SELECT CASE event_id % 4 WHEN 0 THEN map('server', concat('s', event_id % 3), 'content-type', 't') WHEN 1 THEN map('content-type', 't') WHEN 2 THEN map('x', 'y') END AS headers FROM events")
    return rows.groupBy(stats.header_fingerprint(F.col("headers")).alias("server")).agg(F.count(F.lit(1)).alias("n"))


def _order(name: str, make: Callable[[DataFrame], DataFrame]) -> tuple[str, Callable[[SparkSession, str], DataFrame]]:
    return name, lambda spark, sf_dir: make(_ledger(spark, sf_dir))


_KEY = ("court", "year", "number")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f"validator_{c.__name__}": _check(c) for c in (validator.presence, validator.magic, validator.challenge_html, validator.neutral_in_body, validator.enrichment, validator.stem_coords, validator.orphans)},
    "validator_levels": lambda spark, sf_dir: validator.by_level(_found(spark, sf_dir)),
    "validator_lines": lambda spark, sf_dir: validator.shown(written(_found(spark, sf_dir), "found")).groupBy("check").agg(F.count(F.lit(1)).alias("lines"), F.max_by("line", "place").alias("last")).where("lines > 20"),
    "validator_fixes": lambda spark, sf_dir: validator.fixes(written(_found(spark, sf_dir), "found"), _files(spark, sf_dir), RUN_START).groupBy("action", "kind").agg(F.count(F.lit(1)).alias("n")),
    "verify_ledger": lambda spark, sf_dir: marks.verify(_ledger(spark, sf_dir), _files(spark, sf_dir)).select(*_KEY, "status", F.array_join("formats", ",").alias("formats")),
    "translation_queue": lambda spark, sf_dir: _ledger(spark, sf_dir).where("lang = 'tc' and status = 'downloaded'").withColumn("stem", F.concat_ws("_", *(F.col(c).cast("string") for c in _KEY))).join(validator.inventory(_files(spark, sf_dir)).where("suffix = '.tc.html'").select("stem"), "stem", "left_anti").select("stem"),
    "sidecar_counts": lambda spark, sf_dir: stats.local_counts(_ledger(spark, sf_dir), stats.sidecars(_files(spark, sf_dir), ".json")),
    "marked_downloaded": lambda spark, sf_dir: _flat(marks.mark_downloaded(_ledger(spark, sf_dir), _hit(spark, sf_dir, "number % 7 < 3 and number % 2 = 0", F.array(F.lit("pdf")).alias("formats"), F.when(F.col("number") % 4 == 0, F.lit(9)).alias("html_pending")))).select(*_KEY, "status", "formats", "html_pending", "error"),
    "marked_ok": lambda spark, sf_dir: marks.mark_ok(_ledger(spark, sf_dir), _hit(spark, sf_dir, "number % 4 = 0"), _KEY).select(*_KEY, "status", "error"),
    "marked_failed": lambda spark, sf_dir: marks.mark_failed(_ledger(spark, sf_dir), _hit(spark, sf_dir, "number % 4 = 0", F.lit("gone").alias("error"))).select(*_KEY, "status", "error"),
    "marked_enrichment": lambda spark, sf_dir: marks.mark_enrichment(_ledger(spark, sf_dir), _hit(spark, sf_dir, "number % 3 = 0", F.lit("na").alias("state"), F.lit(None).cast("string").alias("error")), "summary_en").select(*_KEY, "summary_en_status", "summary_en_error"),
    "marked_generated": lambda spark, sf_dir: marks.mark_generated(_ledger(spark, sf_dir), _hit(spark, sf_dir, "number % 3 = 0", F.when(F.col("number") % 2 == 0, ".rtf").alias("source"), F.lit("tool").alias("error"))).select(*_KEY, "html_from", "html_error"),
    "bumped_stamps": lambda spark, sf_dir: marks.bump_stamp(_ledger(spark, sf_dir), _hit(spark, sf_dir, "number % 10 = 0", F.lit(5555).alias("html_pending"))).select(*_KEY, "html_pending", "status"),
    "released_scope": lambda spark, sf_dir: marks.release(_ledger(spark, sf_dir), "court", ["hkca", "hkdc"]).select(*_KEY, "status"),
    "reset_scope": lambda spark, sf_dir: marks.reset_failed(_ledger(spark, sf_dir), "court", ["hkcfi"]).select(*_KEY, "status", "error"),
    "reset_enrichment": lambda spark, sf_dir: marks.reset_enrichment(_ledger(spark, sf_dir)).select(*_KEY, "summary_en_status", "summary_en_error", "appeal_history_status"),
    "orphaned_below": lambda spark, sf_dir: marks.mark_orphaned(_ledger(spark, sf_dir), 1600).groupBy("status").agg(F.count(F.lit(1)).alias("n")),
    "run_started_completed": lambda spark, sf_dir: marks.complete_run(marks.complete_run(marks.start_run(_runs(spark, sf_dir), 900, ["hkca"], ["en"])[0], 5, 950, 3), 3, 999, 0).select("generation", "started_at", "completed_at", F.array_join("courts", ",").alias("courts")),
    "runs_with_windows": lambda spark, sf_dir: marks.with_windows(_runs(spark, sf_dir).drop("min_date", "max_date")).select("generation", "completed_at", "min_date"),
    "latest_corpus_run": lambda spark, sf_dir: marks.latest_full_run(_runs(spark, sf_dir)).select("generation", "started_at"),
    "freshness_writers": freshness_writers,
    "recheck_stamped": lambda spark, sf_dir: queues.recheck_queue(_ledger(spark, sf_dir).withColumnsRenamed({"year": "yr", "html_pending": "pending_stamp"}), None, 9000, date(2020, 1, 1)).select("court", "number", "pending_stamp"),
    "pending_enrichment_kinds": lambda spark, sf_dir: queues.pending_enrichment(_ledger(spark, sf_dir), ["summary_en", "appeal_history"], ["hkca", "hkcfa"]).select(*_KEY),
    "pending_generation": lambda spark, sf_dir: queues.pending_generation(_ledger(spark, sf_dir)).select(*_KEY),
    "pending_versions": lambda spark, sf_dir: queues.pending_versions(_ledger(spark, sf_dir)).select(*_KEY),
    "downloaded_keys": lambda spark, sf_dir: queues.downloaded(_ledger(spark, sf_dir), _hit(spark, sf_dir, "number % 3 = 0"), list(_KEY)),
    "listing_left": lambda spark, sf_dir: queues.not_downloaded(_hit(spark, sf_dir, "number % 3 = 0"), _ledger(spark, sf_dir), list(_KEY)),
    "listed_lately": lambda spark, sf_dir: queues.enumerated_lately(_ledger(spark, sf_dir).withColumn("court", F.concat("court", F.col("year").cast("string"))), 0.01, 2510),
    "noteup_queue": lambda spark, sf_dir: queues.fetch_queue(_ledger(spark, sf_dir), _hit(spark, sf_dir, "number % 4 = 0", F.lit("ok").alias("status")), list(_KEY)),
    "cap_queue": lambda spark, sf_dir: queues.cap_grid(spark.sql("SELECT CAST(id AS STRING) AS cap, 'ord' AS abbr, 'en' AS lang, 'ok' AS status FROM range(5, 12)"), 1, 10, ["ord", "reg"], ["en", "tc"]),
    "chosen_buckets": lambda spark, sf_dir: (views(spark, sf_dir, "nation"), queues.buckets(spark.sql(_FRESH), ["cases"], ["s1", "s3", "s5"], None).select("scope", "live_count"))[1],
    "first_of_court": lambda spark, sf_dir: queues.first_in_group(_ledger(spark, sf_dir), "court", "number", 3, ["hkdc", "hkca"]).select("court", "number", "place", "rank"),
    "fetch_counts": lambda spark, sf_dir: stats.by_status(marks.mark_ok(_ledger(spark, sf_dir), _hit(spark, sf_dir, "number % 4 = 0"), _KEY), ["pending", "ok", "error"]),
    "scoped_counts": lambda spark, sf_dir: stats.by_status(stats.scoped(_ledger(spark, sf_dir), "court", ["hkca", "hkdc"]), ["pending", "downloaded", "failed"]).unionByName(stats.by_status(stats.scoped(_ledger(spark, sf_dir), "court", []), ["pending", "downloaded", "failed"])),
    "enrichment_counts": lambda spark, sf_dir: stats.enrichment(_ledger(spark, sf_dir), marks.KINDS, marks.STATUSES),
    "generation_counts": lambda spark, sf_dir: stats.generated(_ledger(spark, sf_dir)),
    "run_progress": lambda spark, sf_dir: monitor.progress(_ledger(spark, sf_dir), 9000, 1).select("total", "downloaded", "pending", "run_start", "source", F.round("hours", 6).alias("hours"), F.round("per_hour", 4).alias("per_hour"), F.round("eta_hours", 6).alias("eta_hours")),
    "error_prefixes": lambda spark, sf_dir: monitor.error_prefixes(_ledger(spark, sf_dir)),
    "event_kinds": lambda spark, sf_dir: monitor.kind_counts(_log(spark, sf_dir)),
    "hot_proxies": lambda spark, sf_dir: monitor.hotspots(_log(spark, sf_dir), 2.0),
    "monitor_alerts": lambda spark, sf_dir: monitor.alerts(monitor.progress(_ledger(spark, sf_dir), 9000, 1), monitor.error_prefixes(_ledger(spark, sf_dir)), monitor.kind_counts(_log(spark, sf_dir)), monitor.hotspots(_log(spark, sf_dir), 2.0), 3).select("level", "rule", "subject", F.round("n", 3).alias("n")),
    "look_back": lambda spark, sf_dir: monitor.window(_log(spark, sf_dir), datetime(2024, 1, 20), 60 * 24).select("event_id"),
    "newest_challenges": lambda spark, sf_dir: monitor.recent_challenges(_log(spark, sf_dir)).select("url", "proxy"),
    "log_tail": lambda spark, sf_dir: monitor.recent_warnings(_log(spark, sf_dir).select(F.col("event_id").alias("position"), F.concat(F.lit("d 01:02:03,4 "), F.when(F.col("event_id") % 9 == 0, "ERROR").otherwise("INFO"), F.lit(" m: e"), F.col("event_id").cast("string")).alias("line"))),
    "duplicate_citations": lambda spark, sf_dir: stats.duplicate_citations(_ledger(spark, sf_dir).select(F.concat(F.lit("N"), (F.col("number") % 1000).cast("string")).alias("neutral"))),
    "seeded_sample": lambda spark, sf_dir: validator.sampled(_ledger(spark, sf_dir), 0, 3).select(*_KEY),
    **{f.__name__: f for f in (download_outcomes, recheck_outcomes, summary_outcomes, conversion_routes, plan_steps, orphan_guard_runs, coverage_canary, freshness_cells, fresh_scopes, simulated_scrape, judgment_sink, document_sinks, merged_decision_sink, event_faults, header_fingerprints)},
}

_ROWS = f"{_C}, r AS (SELECT court, year, number, number AS k, status, error, html_pending, formats_text, html_from, html_error, summary_en_status, summary_en_error, appeal_history_status, last_seen, lang, dt FROM c)"
_EXT = "CASE k % 4 WHEN 0 THEN '.docx' WHEN 1 THEN '.rtf' ELSE '.doc' END"
_REAL = "CASE WHEN k % 13 = 0 THEN NULL WHEN k % 4 = 0 OR k % 17 = 0 THEN '.docx' WHEN k % 4 = 1 THEN '.rtf' ELSE '.doc' END"
_NOFOUND = "CAST(NULL AS VARCHAR) AS expected, CAST(NULL AS VARCHAR) AS observed"
_CHECKS = {
    "presence": "SELECT 'fatal' AS level, court, year, number, concat(folder, stem, '.', f) AS path, f AS expected, CAST(NULL AS VARCHAR) AS observed FROM d, (VALUES ('html'), ('json'), ('txt'), ('doc')) v(f) WHERE (f = 'html' AND k % 3 > 0 AND (k % 10 = 1 OR k % 10 = 2)) OR (f = 'txt' AND k % 3 = 1 AND k % 20 = 3) OR (f = 'doc' AND k % 3 <> 1 AND k % 15 = 0)",
    "magic": f"SELECT 'fatal' AS level, court, year, number, concat(folder, stem, {_EXT}) AS path, {_EXT} AS expected, coalesce({_REAL}, '00000000') AS observed FROM d WHERE k % 3 <> 1 AND k % 15 <> 0 AND {_EXT} IS DISTINCT FROM {_REAL}",
    "challenge_html": f"SELECT 'fatal' AS level, court, year, number, concat(folder, stem, '.html') AS path, {_NOFOUND} FROM d WHERE k % 3 > 0 AND k % 10 <> 1 AND k % 9 = 0 UNION ALL SELECT 'fatal', court, year, number, concat(folder, stem, '.summary_en.html'), NULL, NULL FROM d WHERE k % 30 = 0 AND k % 25 <> 0",
    "neutral_in_body": "SELECT 'warn' AS level, court, year, number, concat(folder, stem, CASE WHEN has_txt THEN '.txt' ELSE '.html' END) AS path, concat('hkx ', k) AS expected, CAST(NULL AS VARCHAR) AS observed FROM (SELECT *, k % 3 = 1 AND k % 20 <> 3 AS has_txt, k % 3 > 0 AND k % 10 <> 1 AS has_html FROM d) t WHERE (has_txt AND k % 8 = 0) OR (NOT has_txt AND has_html AND k % 9 = 0)",
    "enrichment": "SELECT 'fatal' AS level, court, year, number, concat(folder, stem, suffix) AS path, CASE WHEN done THEN 'present' ELSE 'absent' END AS expected, CASE WHEN there THEN 'present' ELSE 'missing' END AS observed FROM (SELECT *, '.summary_en.html' AS suffix, k % 5 = 0 AS done, (k % 5 = 0 AND k % 25 <> 0) OR (k % 5 = 3 AND k % 50 = 3) AS there FROM d UNION ALL SELECT *, '.appeal_history.json', k % 4 = 0, false FROM d) t WHERE done <> there",
    "stem_coords": "SELECT 'fatal' AS level, court, year, number, concat(court, '/', year + 1, '/', stem, '.json') AS path, folder AS expected, concat(court, '/', year + 1, '/') AS observed FROM d WHERE k % 50 = 7",
    "orphans": f"SELECT 'warn' AS level, CAST(NULL AS VARCHAR) AS court, CAST(NULL AS BIGINT) AS year, CAST(NULL AS BIGINT) AS number, concat('hkcfi/2000/note', k, '.json') AS path, {_NOFOUND} FROM d WHERE k % 40 = 4",
}
_ALL = ", ".join(f"f_{n} AS ({q})" for n, q in _CHECKS.items())
_EVERY = " UNION ALL ".join(f"SELECT '{n}' AS chk, level, court, year, number, path FROM f_{n}" for n in _CHECKS)
_E = "SELECT *, CASE event_type WHEN 'view' THEN 'request_success' WHEN 'error' THEN 'request_failed' WHEN 'purchase' THEN 'challenge_detected' WHEN 'click' THEN 'warmup' ELSE 'odd' END AS kind, CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 5 = 0 THEN 1 ELSE user_id END AS proxy FROM events"
_HOT = f"SELECT proxy, failed, round(m, 1) AS mean, round(m + 2 * s, 1) AS threshold FROM (SELECT *, avg(failed) OVER () AS m, stddev_pop(failed) OVER () AS s FROM (SELECT proxy, count(*) FILTER (WHERE kind <> 'request_success') AS failed FROM ({_E}) e WHERE proxy IS NOT NULL AND kind IN ('request_success', 'request_failed', 'challenge_detected') GROUP BY proxy) p) q WHERE s > 0 AND failed > m + 2 * s"
_KINDS = f"SELECT coalesce(k.kind, e.kind) AS kind, coalesce(n, 0) AS n, coalesce(place, 6) AS place FROM (VALUES ('request_success', 0), ('request_failed', 1), ('warmup', 2), ('challenge_detected', 3), ('pool_exhausted', 4), ('degraded', 5)) k(kind, place) FULL JOIN (SELECT kind, count(*) AS n FROM ({_E}) t GROUP BY kind) e ON e.kind = k.kind"
_DONE = "doc_id % 6 = 0"
ORACLE_SQL: dict[str, str] = {
    **{f"validator_{n}": f"{_C} {q}" for n, q in _CHECKS.items()},
    "validator_levels": f"{_C}, {_ALL} SELECT l.level, count(a.level) AS n FROM (VALUES ('fatal'), ('warn'), ('info')) l(level) LEFT JOIN ({_EVERY}) a ON a.level = l.level GROUP BY l.level",
    "validator_lines": f"{_C}, {_ALL} SELECT chk AS \"check\", 21 AS lines, concat('... ', count(*) - 20, ' more') AS last FROM ({_EVERY}) a GROUP BY chk HAVING count(*) > 20",
    "validator_fixes": f"{_C}, {_ALL} SELECT action, kind, count(*) AS n FROM (SELECT DISTINCT 'reset_case' AS action, CAST(NULL AS VARCHAR) AS kind, number, '' AS path FROM ({_EVERY}) a WHERE chk = 'presence' OR (chk IN ('magic', 'challenge_html') AND path NOT LIKE '%.summary_en.html') UNION ALL SELECT DISTINCT 'reset_enrichment', 'summary_en', number, '' FROM f_challenge_html WHERE path LIKE '%.summary_en.html' UNION ALL SELECT DISTINCT 'delete_file', NULL, number, path FROM ({_EVERY}) a WHERE chk IN ('magic', 'challenge_html') UNION ALL SELECT 'delete_file', NULL, k, '' FROM d WHERE k % 40 = 4 AND k < {RUN_START}) t GROUP BY action, kind",
    "verify_ledger": f"{_C}, {_ALL} SELECT court, year, number, CASE WHEN number IN (SELECT number FROM f_presence) THEN 'pending' ELSE status END AS status, CASE WHEN number NOT IN (SELECT number FROM f_presence) THEN formats_text END AS formats FROM c",
    "translation_queue": f"{_C} SELECT stem FROM d WHERE k % 6 = 0",
    "sidecar_counts": f"{_C} SELECT scope, lang, CAST(sum(n) AS BIGINT) AS n FROM (SELECT court AS scope, lang, count(*) AS n FROM d GROUP BY ALL UNION ALL SELECT court, 'tc', count(*) FROM d, (VALUES (1), (2)) v(i) WHERE (i = 1 AND k % 3 = 1) OR (i = 2 AND k % 50 = 7) GROUP BY court UNION ALL SELECT CASE WHEN i = 1 THEN 'hkcfi' ELSE 'other' END, 'tc', count(*) FROM d, (VALUES (1), (2)) v(i) WHERE k % 40 = 3 + i GROUP BY i) t GROUP BY scope, lang",
    "marked_downloaded": f"{_ROWS} SELECT court, year, number, CASE WHEN h THEN 'downloaded' ELSE status END AS status, CASE WHEN h THEN 'pdf' ELSE formats_text END AS formats, CASE WHEN h THEN CASE WHEN k % 4 = 0 THEN 9 END ELSE html_pending END AS html_pending, error FROM (SELECT *, k % 7 < 3 AND k % 2 = 0 AS h FROM r) t",
    "marked_ok": f"{_ROWS} SELECT court, year, number, CASE WHEN k % 4 = 0 THEN 'ok' ELSE status END AS status, CASE WHEN k % 4 > 0 THEN error END AS error FROM r",
    "marked_failed": f"{_ROWS} SELECT court, year, number, CASE WHEN k % 4 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN k % 4 = 0 THEN 'gone' ELSE error END AS error FROM r",
    "marked_enrichment": f"{_ROWS} SELECT court, year, number, CASE WHEN k % 3 = 0 THEN 'na' ELSE summary_en_status END AS summary_en_status, CASE WHEN k % 3 > 0 THEN summary_en_error END AS summary_en_error FROM r",
    "marked_generated": f"{_ROWS} SELECT court, year, number, CASE WHEN k % 3 > 0 THEN html_from WHEN k % 2 = 0 THEN '.rtf' END AS html_from, CASE WHEN k % 3 > 0 THEN html_error WHEN k % 2 = 1 THEN 'tool' END AS html_error FROM r",
    "bumped_stamps": f"{_ROWS} SELECT court, year, number, CASE WHEN k % 10 = 0 THEN 5555 ELSE html_pending END AS html_pending, status FROM r",
    "released_scope": f"{_ROWS} SELECT court, year, number, CASE WHEN k % 7 = 1 AND court IN ('hkca', 'hkdc') THEN 'pending' ELSE status END AS status FROM r",
    "reset_scope": f"{_ROWS} SELECT court, year, number, CASE WHEN k % 7 = 2 AND court = 'hkcfi' THEN 'pending' ELSE status END AS status, CASE WHEN court <> 'hkcfi' THEN error END AS error FROM r",
    "reset_enrichment": f"{_ROWS} SELECT court, year, number, CASE WHEN k % 5 = 2 THEN 'pending' ELSE summary_en_status END AS summary_en_status, CAST(NULL AS VARCHAR) AS summary_en_error, appeal_history_status FROM r",
    "orphaned_below": f"{_ROWS} SELECT CASE WHEN k % 7 > 2 AND (k % 11 = 0 OR 1000 + k < 1600) THEN 'orphaned' ELSE status END AS status, count(*) AS n FROM r GROUP BY 1",
    "run_started_completed": "SELECT r_regionkey AS generation, 100 * r_regionkey AS started_at, CASE WHEN r_regionkey % 4 < 3 THEN 100 * r_regionkey + 50 END AS completed_at, 'hkca,hkcfi' AS courts FROM region UNION ALL SELECT 5, 900, 950, 'hkca'",
    "runs_with_windows": "SELECT r_regionkey AS generation, CAST(NULL AS BIGINT) AS completed_at, CAST(NULL AS VARCHAR) AS min_date FROM region",
    "latest_corpus_run": "SELECT CAST(1 AS BIGINT) AS generation, 100 AS started_at",
    "freshness_writers": "SELECT 'cases' AS kind, concat('s', n) AS scope, 'en' AS lang, CASE WHEN n % 4 = 0 THEN 99 WHEN n % 3 > 0 THEN n % 4 END AS live_count, '2020-01-01' AS live_updated_at, CASE WHEN n % 2 = 0 THEN 50 ELSE 5 END AS live_probed_at, CASE WHEN n % 4 = 2 THEN 'new' WHEN n % 2 = 1 AND n % 5 = 0 THEN 'old' END AS probe_error, CASE WHEN n % 3 = 0 THEN n ELSE n % 2 END AS local_count, CASE WHEN n % 3 = 0 THEN 60 ELSE 6 END AS local_count_at, CASE WHEN n % 4 = 0 THEN 70 ELSE 7 END AS last_scrape_completed_at, CASE WHEN n % 4 > 0 THEN 1 END AS generation FROM (SELECT n_nationkey AS n FROM nation) t UNION ALL SELECT 'cases', 'fresh', 'en', 3, '2021-01-01', 50, NULL, NULL, NULL, NULL, NULL",
    "recheck_stamped": f"{_ROWS} SELECT court, number, html_pending AS pending_stamp FROM r WHERE k % 7 > 2 AND k % 5 = 0 AND substr(dt, 1, 10) >= CAST(DATE '2020-01-01' - 9000 AS VARCHAR)",
    "pending_enrichment_kinds": f"{_ROWS} SELECT court, year, number FROM r WHERE k % 7 > 2 AND court IN ('hkca', 'hkcfa') AND (k % 5 > 2 OR k % 4 > 0)",
    "pending_generation": f"{_ROWS} SELECT court, year, number FROM r WHERE k % 7 > 2 AND k % 3 = 0 AND k % 12 NOT IN (3, 6)",
    "pending_versions": f"{_ROWS} SELECT court, year, number FROM r WHERE k % 7 = 0",
    "downloaded_keys": f"{_ROWS} SELECT court, year, number FROM r WHERE k % 3 = 0 AND k % 7 > 2",
    "listing_left": f"{_ROWS} SELECT court, year, number FROM r WHERE k % 3 = 0 AND k % 7 <= 2",
    "listed_lately": f"{_ROWS} SELECT concat(court, year) AS court FROM r GROUP BY 1 HAVING 2510 - max(1000 + k) FILTER (WHERE k % 11 > 0) < 36",
    "noteup_queue": f"{_ROWS} SELECT court, year, number, 'ok' AS status FROM r WHERE k % 4 = 0 UNION ALL SELECT court, year, number, 'pending' FROM r WHERE k % 4 > 0 AND k % 7 > 2",
    "cap_queue": "SELECT CAST(cap AS VARCHAR) AS cap, abbr, lang, CASE WHEN abbr = 'ord' AND lang = 'en' AND cap >= 5 THEN 'ok' ELSE 'pending' END AS status FROM range(1, 10) r(cap), (VALUES ('ord'), ('reg')) a(abbr), (VALUES ('en'), ('tc')) l(lang) UNION ALL SELECT CAST(cap AS VARCHAR), 'ord', 'en', 'ok' FROM range(10, 12) r(cap)",
    "chosen_buckets": "SELECT concat('s', n_nationkey) AS scope, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey % 4 END AS live_count FROM nation WHERE n_nationkey IN (1, 3, 5)",
    "first_of_court": f"{_ROWS} SELECT court, number, CAST(p AS INT) AS place, CASE WHEN court = 'hkdc' THEN 0 ELSE 1 END AS rank FROM (SELECT *, row_number() OVER (PARTITION BY court ORDER BY number) AS p FROM r) t WHERE p <= 3 AND court IN ('hkdc', 'hkca')",
    "fetch_counts": f"{_ROWS} SELECT count(*) AS total, count(*) FILTER (WHERE k % 4 > 0 AND k % 7 = 0) AS pending, count(*) FILTER (WHERE k % 4 = 0) AS ok, 0 AS error FROM r",
    "scoped_counts": f"{_ROWS} SELECT count(*) AS total, count(*) FILTER (WHERE k % 7 = 0) AS pending, count(*) FILTER (WHERE k % 7 > 2) AS downloaded, count(*) FILTER (WHERE k % 7 = 2) AS failed FROM r WHERE court IN ('hkca', 'hkdc') UNION ALL SELECT 0, 0, 0, 0",
    "enrichment_counts": f"{_ROWS} SELECT 'summary_en' AS kind, count(*) FILTER (WHERE k % 5 > 2) AS pending, count(*) FILTER (WHERE k % 5 = 0) AS downloaded, count(*) FILTER (WHERE k % 5 = 1) AS na, count(*) FILTER (WHERE k % 5 = 2) AS failed FROM r UNION ALL SELECT 'summary_zh', count(*), 0, 0, 0 FROM r UNION ALL SELECT 'appeal_history', count(*) FILTER (WHERE k % 4 > 0), count(*) FILTER (WHERE k % 4 = 0), 0, 0 FROM r",
    "generation_counts": f"{_ROWS} SELECT CASE k % 12 WHEN 3 THEN '.doc' WHEN 6 THEN 'failed' ELSE 'pending' END AS source, count(*) AS n FROM r WHERE k % 7 > 2 AND k % 3 = 0 GROUP BY 1",
    "run_progress": f"{_ROWS} SELECT total, downloaded, pending, run_start, 'cases' AS source, round(hours, 6) AS hours, round(downloaded / hours, 4) AS per_hour, round((pending + in_progress) * hours / downloaded, 6) AS eta_hours FROM (SELECT count(*) AS total, count(*) FILTER (WHERE k % 7 > 2) AS downloaded, count(*) FILTER (WHERE k % 7 = 0) AS pending, count(*) FILTER (WHERE k % 7 = 1) AS in_progress, min(1000 + k) FILTER (WHERE k % 11 > 0) AS run_start, (9000 - min(1000 + k) FILTER (WHERE k % 11 > 0)) / 3600.0::DOUBLE AS hours FROM r) t",
    "error_prefixes": "SELECT concat('HTTP ', 500 + o_custkey % 5, ': no') AS prefix, count(*) AS n FROM orders WHERE o_orderkey % 7 = 2 GROUP BY 1",
    "event_kinds": _KINDS,
    "hot_proxies": _HOT,
    "monitor_alerts": f"SELECT CASE WHEN n > 100 THEN 'CRITICAL' ELSE 'WARN' END AS level, 'error_prefix' AS rule, prefix AS subject, n FROM (SELECT concat('HTTP ', 500 + o_custkey % 5, ': no') AS prefix, CAST(count(*) AS DOUBLE) AS n FROM orders WHERE o_orderkey % 7 = 2 GROUP BY 1) t WHERE n >= 20 UNION ALL SELECT 'CRITICAL', 'in_progress', '', n FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM orders WHERE o_orderkey % 7 = 1) t WHERE n > 12 UNION ALL SELECT CASE WHEN n < 4000 THEN 'CRITICAL' ELSE 'WARN' END, 'rate', '', round(n, 3) FROM (SELECT count(*) FILTER (WHERE o_orderkey % 7 > 2) / ((9000 - min(1000 + o_orderkey) FILTER (WHERE o_orderkey % 11 > 0)) / 3600.0::DOUBLE) AS n FROM orders) t WHERE n <= 6000 UNION ALL SELECT 'WARN', 'hotspot', CAST(proxy AS VARCHAR), failed FROM ({_HOT}) h",
    "look_back": "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-19 00:00:00'",
    "newest_challenges": "SELECT concat('/u', event_id) AS url, CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 5 = 0 THEN 1 ELSE user_id END AS proxy FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, concat('/u', event_id) LIMIT 5",
    "log_tail": "SELECT event_id AS position, concat('[01:02:03] e', event_id) AS said FROM events WHERE event_id % 9 = 0 ORDER BY event_id DESC LIMIT 5",
    "duplicate_citations": "SELECT concat('N', o_orderkey % 1000) AS neutral, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1",
    "seeded_sample": f"{_ROWS} SELECT court, year, number FROM r WHERE k % 7 > 2",
    "download_outcomes": "SELECT doc_id, outcome, CASE WHEN outcome = 'downloaded' THEN CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 6 > 0 THEN 'html,txt' END WHEN good AND doc_id % 6 > 0 THEN 'doc,html' WHEN good THEN 'doc' ELSE 'html' END END AS saved, outcome = 'downloaded' AND doc_id % 6 = 0 AS html_later FROM (SELECT *, CASE WHEN doc_id % 6 > 0 AND doc_id % 11 = 0 THEN 'challenge' WHEN doc_id % 6 = 0 AND NOT tried THEN 'empty' WHEN tried AND doc_id % 5 = 1 THEN 'doc_invalid_magic' WHEN doc_id % 6 = 0 AND NOT good THEN 'doc_failed' ELSE 'downloaded' END AS outcome FROM (SELECT doc_id, doc_id % 3 > 0 AND doc_id % 4 > 0 AS tried, doc_id % 3 > 0 AND doc_id % 4 > 0 AND doc_id % 5 NOT IN (1, 2) AS good FROM documents) t) u",
    "recheck_outcomes": "SELECT doc_id, CASE WHEN doc_id % 8 = 0 OR (doc_id % 11 = 0 AND doc_id % 6 > 0) THEN 'failed' WHEN doc_id % 6 = 0 THEN 'still_pending' ELSE 'newly_captured' END AS outcome, CASE WHEN doc_id % 8 > 0 AND doc_id % 11 > 0 AND doc_id % 6 > 0 THEN 'doc,html,json,txt' ELSE 'doc,json' END AS formats FROM documents",
    "summary_outcomes": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'na' WHEN doc_id % 11 = 0 AND doc_id % 6 > 0 THEN 'failed' ELSE 'downloaded' END AS state, CASE WHEN doc_id % 4 > 0 AND doc_id % 11 = 0 AND doc_id % 6 > 0 THEN 'challenge page in a press summary' END AS error FROM documents",
    "conversion_routes": "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'pandoc' WHEN 3 THEN 'pandoc' WHEN 4 THEN 'pandoc' END AS tool FROM documents",
    "plan_steps": "SELECT * FROM (VALUES (1, 'check_freshness', NULL, NULL), (2, 'scrape', '22/02/2026', '04/03/2026'), (3, 'recheck_html', NULL, NULL), (4, 'generate_html', NULL, NULL), (5, 'scrape_noteup', NULL, NULL), (6, 'enrich', NULL, NULL), (7, 'coverage_canary', NULL, NULL), (8, 'scrape_hopt', NULL, NULL), (9, 'scrape_legis', NULL, NULL), (10, 'backfill_case_translations', NULL, NULL)) t(place, step, min_date, max_date)",
    "orphan_guard_runs": "SELECT * FROM (VALUES ('whole', 40, NULL), ('more', NULL, 'run 1 does not cover [''hkdc'', ''sc'']'), ('none', NULL, 'no completed full run')) t(wanted, cutoff, why)",
    "coverage_canary": f"{_C} SELECT court, lang, live, local, live - local AS diff FROM (SELECT court, lang, count(*) AS live, count(*) FILTER (WHERE status = 'downloaded') AS local FROM c WHERE court <> 'hkdc' GROUP BY ALL) t WHERE live - local >= 5 ORDER BY diff DESC, court, lang LIMIT 4",
    "freshness_cells": "SELECT concat('s', n) AS slug, CASE WHEN live IS NULL THEN concat(n % 2, ' / —') WHEN live = n % 2 THEN concat(n % 2, ' / ', live) ELSE concat('**', n % 2, ' / ', live, ' (', CASE WHEN live > n % 2 THEN '+' ELSE '' END, live - n % 2, ')**') END AS en_counts, '2020-01-01' AS en_updated, CASE WHEN n % 4 = 0 THEN '**9 / 8 (-1)**' ELSE '—' END AS tc_counts, '—' AS tc_updated FROM (SELECT n_nationkey AS n, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey % 4 END AS live FROM nation) t",
    "fresh_scopes": "SELECT n_nationkey AS scope FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey % 5 = 0",
    "simulated_scrape": "SELECT concat('s', n_nationkey) AS scope, CASE WHEN n_nationkey % 3 > 0 AND n_nationkey % 4 = n_nationkey % 2 THEN 1234 ELSE 7 END AS last_scrape_completed_at FROM nation",
    "judgment_sink": "SELECT concat('hkca/2001/hkca_2001_', doc_id, '.tc.', s) AS path, CASE s WHEN 'html' THEN concat('<p>', doc_id, '</p> <br>end') WHEN 'txt' THEN concat(doc_id, chr(10), 'end') ELSE concat('https://example.org/', lang, '/cases/hkca/2001/', doc_id) END AS said FROM documents, (VALUES ('html'), ('txt'), ('json')) v(s) WHERE s = 'html' OR doc_id % 2 = 1",
    "document_sinks": "WITH b AS (SELECT doc_id AS n, CASE WHEN doc_id % 2 = 0 THEN 'tc' ELSE 'en' END AS l FROM documents) SELECT concat('legis/cap/', n, '/cap_', n, '_', l, '.versions.json') AS path, '[]' AS content FROM b UNION ALL SELECT concat('legis/cap/', n, '/cap_', n, '_', l, '.content.json'), concat('c', n) FROM b WHERE n % 3 > 0 UNION ALL SELECT concat('treaties/hkts/nd/hkts_nd_', n, '_', l, '.json'), '{}' FROM b UNION ALL SELECT concat('treaties/hkts/nd/hkts_nd_', n, '_', l, '.pdf'), concat('c', n) FROM b WHERE n % 3 > 0 UNION ALL SELECT concat('treaties/hkts/nd/hkts_nd_', n, '_', l, '.txt'), 'text' FROM b WHERE n % 5 = 0 UNION ALL SELECT concat('ukpc/1990/ukpc_1990_', n, CASE WHEN l = 'tc' THEN '.tc' ELSE '' END, '.html'), '<p>a</p>b' FROM b UNION ALL SELECT concat('ukpc/1990/ukpc_1990_', n, CASE WHEN l = 'tc' THEN '.tc' ELSE '' END, '.txt'), concat('a', chr(10), 'b') FROM b UNION ALL SELECT concat('hkca/2000/hkca_2000_', n, CASE WHEN n % 2 = 0 THEN '.summary_zh.html' ELSE '.appeal_history.json' END), 'b' FROM b UNION ALL SELECT concat('noteup/', n, '.json'), '[1]' FROM b",
    "merged_decision_sink": "SELECT 2001 AS year, s_suppkey AS num, 'en' AS lang, concat('{\"listed\":{\"title\":\"', s_name, '\"},\"published\":{\"filename\":\"f', s_suppkey, '\"}}') AS metadata FROM supplier",
    "event_faults": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'not_json' WHEN 2 THEN CASE i WHEN 1 THEN 'missing:proxy' ELSE 'unknown:extra_1' END WHEN 3 THEN 'unknown_kind' WHEN 4 THEN 'missing:error_class' ELSE 'not_json' END AS fault FROM events, (VALUES (1), (2)) v(i) WHERE event_id % 6 <> 1 AND (i = 1 OR event_id % 6 = 2)",
    "header_fingerprints": "SELECT CASE event_id % 4 WHEN 0 THEN concat('s', event_id % 3) WHEN 1 THEN 't' ELSE '?' END AS server, count(*) AS n FROM events GROUP BY 1",
}
