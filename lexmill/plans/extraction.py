"""Extraction from payloads, walks over the citation graph, and replays: DataFrame plans with the oracle SQL of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import numbers, payloads, text
from lexmill.operators import graph
from lexmill.session import table, working_path
from lexmill.sources import versions
from lexmill.streaming import ingest, replay

#: Slugs of the two endpoint families and of treaties.
OTHER_P = ("pd",)
OTHER_O = ("hkiac", "hklrccp", "hklrcr", "pcpdaab", "pcpdc")
TREATIES = ("bacpg", "bahkg", "hktmc", "hktml", "hkts")

_HEADS = "CASE doc_id % 5 WHEN 0 THEN '504B0304' WHEN 1 THEN 'D0CF11E0' WHEN 2 THEN 'DBA52D00' WHEN 3 THEN '7B5C7274' ELSE '' END"
_SLUGS = ("ukpc", "hkcfi", "histlaw", "bacpg", "hkts", "pd", "pcpdaab", "unheard")
_SLUG = "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SLUGS)) + " END"
_BUCKET = "CASE p_size % 4 WHEN 0 THEN 'cases' WHEN 1 THEN 'legis' WHEN 2 THEN 'other' ELSE 'none' END"
_SUFFIX = "CASE o_orderkey % 6 WHEN 0 THEN '.html' WHEN 1 THEN '.tc.html' WHEN 2 THEN '.appeal_history.json' WHEN 3 THEN '.generated.html' WHEN 4 THEN '.pdf' ELSE '.docx' END"
_NAME = "concat('hkcfi_', CAST(year(o_orderdate) AS VARCHAR(4)), '_', CAST(o_orderkey AS VARCHAR(20)))"
_CITED = "concat('AAB ', CAST(l_linenumber AS VARCHAR(9)), ', ', CAST(l_linenumber + 2 AS VARCHAR(9)), '-', CAST(l_linenumber + 4 AS VARCHAR(9)), '/', CAST(1990 + l_partkey % 30 AS VARCHAR(9)), ' (both)')"


def magic_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = table(spark, sf_dir, "documents").select("doc_id", F.unhex(F.concat(F.expr(_HEADS), F.hex(F.substring("text", 1, 4)))).alias("body"))
    return bodies.select("doc_id", text.document_extension(F.col("body")).alias("extension"))


def needle_in_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.holds(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def challenge_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("html", F.expr("CASE page_id % 7 WHEN 0 THEN concat(html, ' Just a Moment... ') WHEN 1 THEN concat('系統維護', html) ELSE html END"))
    return pages.select("page_id", payloads.challenge_page(F.col("html")).alias("challenge"))


def anchor_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.anchors(table(spark, sf_dir, "pages")).select("page_id", "position", "href")


def lang_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = payloads.anchors(table(spark, sf_dir, "pages")).withColumn("lang", F.regexp_extract("html", '<html lang="([a-z]+)"', 1))
    slug = F.regexp_extract("href", "^/([a-z]+)$", 1)
    rows = found.select(slug.alias("slug"), "lang").where("slug != '' and lang != ''").groupBy("slug").agg(F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"))
    return rows


def stem_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "orders").select(F.expr(f"concat({_NAME}, {_SUFFIX})").alias("name"))
    return names.select("name", payloads.stem(F.col("name")).alias("stem"))


def num_list_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = table(spark, sf_dir, "lineitem").select(F.expr(_CITED).alias("said")).distinct()
    return numbers.number_pairs(cited, F.col("said")).select("said", "year", "num")


def bucket_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "part").select("p_partkey", F.expr(_BUCKET).alias("bucket"), F.expr(_SLUG).alias("slug"))
    slug = F.col("slug")
    by_bucket = {
        "cases": F.when(slug == "ukpc", "cases-ukpc").otherwise("cases"),
        "legis": F.when(slug == "histlaw", "legis-histlaw").when(slug.isin(*TREATIES), "legis-hopt").otherwise("legis"),
        "other": F.when(slug.isin(*OTHER_P), "other-P").when(slug.isin(*OTHER_O), "other-O").otherwise("other-unknown"),
    }
    category = F.coalesce(*(F.when(F.col("bucket") == b, c) for b, c in by_bucket.items()))
    kind = F.when(F.col("category").isin("cases", "cases-ukpc"), "cases").when(F.col("category") == "legis", "legis").when(F.col("category").isin("legis-hopt", "legis-histlaw", "other-O", "other-P"), "hopt")
    return pairs.withColumn("category", category).withColumn("kind", kind)


def _noteup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON array of citing cases for each part; every fifth citing case's path is no case's."""
    path = F.expr("concat(CASE WHEN l_orderkey % 5 = 0 THEN '/en/other/c/' ELSE '/en/cases/c/' END, CAST(1990 + l_partkey % 30 AS STRING), '/', CAST(l_orderkey AS STRING))")
    entry = F.struct("l_orderkey", "l_linenumber", path.alias("path"), F.col("l_quantity").cast("int").alias("citation_frequency"), F.array(F.lit("x"), F.lit("")).alias("parallel"))
    entries = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return entries.select("l_partkey", F.to_json("e").alias("body"))


def noteup_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.noteup_edges(_noteup(spark, sf_dir), "l_partkey", "body").withColumn("parallel", F.array_join("parallel", ","))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("from_key"), F.col("l_partkey").alias("to_key"))


def _walk(hops: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return graph.shortest_paths(_edges(spark, sf_dir), spark.range(1, 2).toDF("node"), hops)

    return run


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.html_to_text("html").alias("text"))


def citation_fold_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.citation_fold(F.concat(F.lit("[2001]  ＨＫＣＦＩ "), F.col("o_orderkey").cast("string"))).alias("folded"))


def stream_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of all events run to its end; the last state of every window. (A pattern as path takes a file or a folder.)"""
    path = working_path(spark, "kind-counts")
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]").select("ts", F.col("event_type").alias("kind"))
    write = ingest.kind_counts(stream).writeStream.outputMode("complete").option("checkpointLocation", working_path(spark, "kind-counts-log")).trigger(availableNow=True)
    write.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start().awaitTermination()
    return spark.read.schema("start timestamp, kind string, n bigint").parquet(path)


def stream_ingest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New orders as snapshots, merged by customer into a versioned state: the latest order of each, and how many came."""
    state = working_path(spark, "ingest")

    def merge(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        new = batch.groupBy("o_custkey").agg(F.max("o_orderkey").alias("latest"), F.count(F.lit(1)).alias("orders"))
        if old is None:
            return new
        return new.unionByName(old).groupBy("o_custkey").agg(F.max("latest").alias("latest"), F.sum("orders").alias("orders"))

    orders = table(spark, sf_dir, "orders")
    stream = spark.readStream.schema(orders.schema).parquet(f"{sf_dir}/orders.parque[t]").select("o_custkey", "o_orderkey")
    ingest.ingest_into(stream, state, merge, working_path(spark, "ingest-log")).awaitTermination()
    last = versions.latest(spark, state)
    return versions.current(spark, state) if last else spark.createDataFrame([], "o_custkey bigint, latest bigint, orders bigint")


def circuit_breaker_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event but a purchase counts as a failure, so that runs of five occur."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("proxy"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("event_type") == "purchase").alias("ok"))
    return replay.circuit_breaker(events)


_WALK_SQL = """
WITH RECURSIVE both_ways AS (SELECT DISTINCT * FROM (SELECT l_orderkey AS node, l_partkey AS other FROM lineitem UNION ALL SELECT l_partkey, l_orderkey FROM lineitem) t WHERE node <> other),
walk(node, hop) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT b.other, w.hop + 1 FROM walk w JOIN both_ways b ON b.node = w.node WHERE w.hop < {hops}),
least_hop AS (SELECT node, min(hop) AS hop FROM walk GROUP BY node)
SELECT l.node, l.hop, min(p.node) AS via FROM least_hop l LEFT JOIN both_ways b ON b.other = l.node LEFT JOIN least_hop p ON p.node = b.node AND p.hop = l.hop - 1 GROUP BY l.node, l.hop"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "magic_route": magic_route,
    "needle_in_body": needle_in_body,
    "challenge_flag": challenge_flag,
    "anchor_extract": anchor_extract,
    "lang_matrix": lang_matrix,
    "stem_of": stem_of,
    "num_list_expand": num_list_expand,
    "bucket_classify": bucket_classify,
    "noteup_edges": noteup_edges,
    "neighbourhood": _walk(2),
    "shortest_path": _walk(6),
    "html_to_text": html_to_text,
    "citation_fold_nfkc": citation_fold_nfkc,
    "stream_kind_counts": stream_kind_counts,
    "stream_ingest_merge": stream_ingest_merge,
    "circuit_breaker_replay": circuit_breaker_replay,
}

ORACLE_SQL: dict[str, str] = {
    "magic_route": f"SELECT doc_id, CASE substr(head, 1, 8) WHEN '504B0304' THEN '.docx' WHEN 'D0CF11E0' THEN '.doc' WHEN 'DBA52D00' THEN '.doc' WHEN '7B5C7274' THEN '.rtf' END AS extension FROM (SELECT doc_id, concat({_HEADS}, hex(substr(text, 1, 4))) AS head FROM documents) t",
    "needle_in_body": "SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "challenge_flag": "SELECT page_id, page_id % 7 IN (0, 1) OR " + " OR ".join(f"contains(lower(html), lower('{m}'))" for m in payloads.CHALLENGE_MARKERS) + " AS challenge FROM pages",
    "anchor_extract": "SELECT page_id, CAST(i - 1 AS INT) AS position, hrefs[i] AS href FROM (SELECT page_id, hrefs, unnest(range(1, len(hrefs) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"', 1) AS hrefs FROM pages) t) u",
    "lang_matrix": "SELECT slug, string_agg(lang, ',' ORDER BY lang) AS langs FROM (SELECT DISTINCT regexp_extract(href, '^/([a-z]+)$', 1) AS slug, lang FROM (SELECT unnest(regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"', 1)) AS href, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages) t) u WHERE slug <> '' AND lang <> '' GROUP BY slug",
    "stem_of": f"SELECT concat({_NAME}, {_SUFFIX}) AS name, CASE WHEN o_orderkey % 6 <> 4 THEN {_NAME} END AS stem FROM orders",
    "num_list_expand": f"SELECT said, yr AS year, n AS num FROM (SELECT DISTINCT {_CITED} AS said, CAST(1990 + l_partkey % 30 AS INT) AS yr, CAST(l_linenumber AS INT) AS l FROM lineitem) t, LATERAL (SELECT unnest([l, l + 2, l + 3, l + 4]) AS n) u",
    "bucket_classify": f"""
        SELECT p_partkey, bucket, slug, category, CASE WHEN category IN ('cases', 'cases-ukpc') THEN 'cases' WHEN category = 'legis' THEN 'legis' WHEN category IN ('legis-hopt', 'legis-histlaw', 'other-O', 'other-P') THEN 'hopt' END AS kind
        FROM (SELECT *, CASE WHEN bucket = 'cases' AND slug = 'ukpc' THEN 'cases-ukpc' WHEN bucket = 'cases' THEN 'cases' WHEN bucket = 'legis' AND slug = 'histlaw' THEN 'legis-histlaw' WHEN bucket = 'legis' AND slug IN {TREATIES} THEN 'legis-hopt'
                     WHEN bucket = 'legis' THEN 'legis' WHEN bucket = 'other' AND slug = 'pd' THEN 'other-P' WHEN bucket = 'other' AND slug IN {OTHER_O} THEN 'other-O' WHEN bucket = 'other' THEN 'other-unknown' END AS category
              FROM (SELECT p_partkey, {_BUCKET} AS bucket, {_SLUG} AS slug FROM part) t) u""",
    "noteup_edges": """
        SELECT concat('c/', CAST(1990 + l_partkey % 30 AS VARCHAR), '/', CAST(l_orderkey AS VARCHAR)) AS from_key, l_partkey AS to_key, 'en' AS citer_lang, CAST(l_quantity AS INT) AS citer_freq, CAST(rn - 1 AS INT) AS position, 'x' AS parallel
        FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, CAST(l_quantity AS INT)) AS rn FROM lineitem) t WHERE l_orderkey % 5 <> 0""",
    "neighbourhood": _WALK_SQL.format(hops=2),
    "shortest_path": _WALK_SQL.format(hops=6),
    "stream_kind_counts": "SELECT date_trunc('hour', ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_ingest_merge": "SELECT o_custkey, max(o_orderkey) AS latest, count(*) AS orders FROM orders GROUP BY o_custkey",
}
