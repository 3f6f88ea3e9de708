"""Payloads and names: the functions over captured listings and documents, on payloads made of the driver tables; the oracle computes
what must come out from the tables themselves, without a payload."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import listings, numbers, scalars, text
from lexmill.operators import merge
from lexmill.session import table, views

HOST, BASE = "example.org", "https://example.org"
_COURT = "CASE o_custkey % 4 WHEN 0 THEN 'hkcfi' WHEN 1 THEN 'hkca' WHEN 2 THEN 'hkcfa' ELSE 'hkdc' END"
_YEAR = "CAST(year(o_orderdate) AS INT)"


def _sql(spark: SparkSession, sf_dir: str, body: str, *tables: str) -> DataFrame:
    views(spark, sf_dir, *tables)
    return spark.sql(body)


def case_url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = _sql(spark, sf_dir, f"""SELECT o_orderkey, concat(CASE o_orderkey % 5 WHEN 0 THEN 'https://www.example.org' WHEN 1 THEN 'http://example.org' WHEN 2 THEN 'https://example.com' ELSE 'https://example.org' END,
        '/', CASE WHEN o_orderkey % 7 = 0 THEN 'sc' ELSE 'tc' END, '/cases/', {_COURT}, '/', {_YEAR}, '/', o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '/' ELSE '' END) AS url FROM orders""", "orders")  # fmt: skip
    return urls.withColumn("c", scalars.case_url(F.col("url"), HOST)).select("o_orderkey", "c.lang", "c.court", "c.year", "c.number")


def case_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, f"SELECT o_orderkey, {_COURT} AS court, {_YEAR} AS year FROM orders", "orders")
    c = [F.col(x) for x in ("court", "year", "o_orderkey")]
    stem = scalars.case_key(*c, "_")
    back = scalars.stem_parts(F.when(F.col("o_orderkey") % 3 == 0, F.upper(stem)).otherwise(stem))
    url = listings.query_url(BASE, "getjudgment", lang=F.lit("en"), abbr=c[0], year=c[1], num=c[2])
    return rows.select("o_orderkey", scalars.case_key(*c).alias("case_key"), stem.alias("stem"), url.alias("url"), back["number"].alias("back"))


def court_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = f"""named_struct('path', concat(CASE WHEN o_orderkey % 5 = 0 THEN '/en/other/' ELSE 'x/en/cases/' END, {_COURT}, '/', {_YEAR}, '/', o_orderkey), 'neutral', CASE WHEN o_orderkey % 4 > 0 THEN concat('N', o_orderkey) END,
        'date', CAST(o_orderdate AS STRING), 'cases', CASE WHEN o_orderkey % 3 > 0 THEN array(named_struct('title', concat('T', o_orderkey)), named_struct('title', 'second')) END)"""  # fmt: skip
    pages = _sql(spark, sf_dir, f"SELECT o_custkey, to_json(named_struct('totalfiles', count(*), 'judgments', transform(sort_array(collect_list(struct(o_orderkey, {entry} AS e))), x -> x.e))) AS body FROM orders GROUP BY o_custkey", "orders")
    return listings.court_listing(pages)


def statute_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = "struct(p_partkey, named_struct('num', CASE WHEN p_partkey % 6 > 0 THEN CAST(p_partkey AS STRING) END, 'title', CASE WHEN p_partkey % 5 > 0 THEN p_name END) AS e)"
    pages = _sql(spark, sf_dir, f"SELECT p_size, to_json(named_struct('totalfiles', count(*), 'files', transform(sort_array(collect_list({entry})), x -> x.e))) AS body FROM part GROUP BY p_size", "part")
    return listings.statute_listing(pages).select("*", listings.page_count(F.col("total"), 10).alias("pages"))


def pages_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages 1, 2, 3, ... of 1, 2, 0, 1, ... files; in all 3 files of even orders, and 4 of odd ones."""
    files = "array_join(transform(sequence(1, page % 3), i -> '{\"num\":\"1\"}'), ',')"
    pages = _sql(spark, sf_dir, f"SELECT o_orderkey, page, concat('{{\"totalfiles\":', 3 + o_orderkey % 2, ',\"files\":[', CASE WHEN page % 3 > 0 THEN {files} ELSE '' END, ']}}') AS body FROM (SELECT o_orderkey, explode(sequence(1, 6)) AS page FROM orders)", "orders")
    return listings.pages_read(pages, ["o_orderkey"]).select("o_orderkey", "page")


_PATHS = "CASE o_orderkey % 6 WHEN 0 THEN '/en/legis/hkts/nd/' WHEN 1 THEN '/tc/legis/hkts/1999/' WHEN 2 THEN '/sc/other/pd/2001/' WHEN 3 THEN '/1997/' WHEN 4 THEN '/en/cases/ukpc/1998/' ELSE '/odd/' END"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = f"struct(o_orderkey, named_struct('path', concat({_PATHS}, o_orderkey, '/'), 'title', CASE WHEN o_orderkey % 4 > 0 THEN concat('T', o_orderkey) END, 'neutral', concat('N', o_orderkey), 'date', CAST(o_orderdate AS STRING)) AS e)"
    return _sql(spark, sf_dir, f"SELECT o_custkey, to_json(named_struct('totalfiles', count(*), 'files', transform(sort_array(collect_list({entry})), x -> x.e))) AS body FROM orders GROUP BY o_custkey", "orders")


def treaty_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.treaty_listing(_files(spark, sf_dir))


def secondary_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.secondary_listing(_files(spark, sf_dir))[0]


def secondary_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.secondary_listing(_files(spark, sf_dir))[1]


def privy_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.privy_listing(_files(spark, sf_dir))


def privy_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetched = _sql(spark, sf_dir, "SELECT 'ukpc' AS abbr, CAST(doc_id AS INT) % 50 + 1950 AS year, doc_id AS num, lang, to_json(named_struct('title', source, 'content', CASE WHEN doc_id % 5 = 0 THEN '  ' WHEN doc_id % 7 > 0 THEN text END)) AS body FROM documents", "documents")
    return listings.privy_document(fetched)


def judgment_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = "CASE WHEN doc_id % 3 > 0 THEN array(named_struct('title', source, 'act', CAST(doc_id AS STRING))) END"
    fetched = _sql(spark, sf_dir, f"SELECT doc_id, to_json(named_struct('db', lang, 'neutral', CASE WHEN doc_id % 4 > 0 THEN concat('N', doc_id) END, 'content', text, 'doc', CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'x.doc' END, 'has_translation', CASE WHEN doc_id % 5 > 0 THEN doc_id % 5 = 1 END, 'cases', {cases})) AS body FROM documents", "documents")
    return listings.judgments(fetched).withColumn("parallel", F.size("parallel"))


_CAPS = "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, CASE l_partkey % 3 WHEN 0 THEN 'ord' WHEN 1 THEN 'reg' ELSE 'instrument' END AS abbr, CASE WHEN l_orderkey % 4 = 0 THEN '' ELSE concat(l_orderkey % 50, 'A') END AS num FROM lineitem"


def related_caps_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinance to regulation edges; of equal ones (parent, child, language) one stays."""
    entries = "to_json(transform(sort_array(collect_list(struct(l_orderkey, l_linenumber, num))), x -> named_struct('num', x.num, 'title', concat('cap ', x.num))))"
    fetched = _sql(spark, sf_dir, f"SELECT l_partkey AS cap, abbr, 'en' AS lang, {entries} AS body FROM ({_CAPS}) GROUP BY l_partkey, abbr", "lineitem")
    edges = listings.related_caps(fetched)
    return merge.first_wins(edges, ["parent_cap", "child_cap", "lang"], ["title"]).withColumn("alpha", text.alpha_suffix(F.col("child_cap")))


def statute_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = _sql(spark, sf_dir, "SELECT o_orderkey AS num, CASE WHEN o_orderkey % 5 = 0 THEN '[]' ELSE concat('[{\"id\":', o_orderkey * 10, ',\"date\":\"2001-01-01\"},{\"id\":1,\"date\":\"2020-01-01\"}]') END AS body FROM orders", "orders")
    tocs = _sql(spark, sf_dir, "SELECT o_orderkey * 10 AS vid, concat('toc ', o_orderkey) AS content FROM orders WHERE o_orderkey % 3 > 0", "orders")
    return listings.statute_documents(versions, tocs, ["num"])


def history_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = "CAST(o_orderkey AS STRING) AS num"
    documents = _sql(spark, sf_dir, f"SELECT {rows}, CASE WHEN o_orderstatus = 'F' THEN 'downloaded' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey * 10 + 1 END AS latest_vid FROM orders", "orders")
    versions = _sql(spark, sf_dir, f"SELECT {rows}, concat('[{{\"id\":', o_orderkey * 10 + 1, ',\"date\":\"d1\"}},{{\"id\":', o_orderkey * 10 + 2, '}},{{\"date\":\"no id\"}},{{\"id\":\"x\"}}]') AS body FROM orders", "orders")
    sidecars = _sql(spark, sf_dir, f"SELECT {rows}, o_orderkey * 10 + 2 AS vid FROM orders WHERE o_orderkey % 4 = 0", "orders")
    return listings.history_targets(documents, versions, sidecars, ["num"])


def pdf_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    metadata = _sql(spark, sf_dir, "SELECT o_orderkey, to_json(named_struct('pdf', CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat('https://other.example/', o_orderkey) WHEN 2 THEN concat('/static/', o_orderkey) ELSE concat('static/', o_orderkey) END)) AS body FROM orders", "orders")
    files = _sql(spark, sf_dir, "SELECT concat(CASE WHEN o_orderkey % 4 = 1 THEN 'https://other.example/' ELSE 'https://example.org/static/' END, o_orderkey) AS url, CAST(CASE WHEN o_orderkey % 5 = 0 THEN '<html>' ELSE '%PDF-1.4' END AS BINARY) AS content FROM orders WHERE o_orderkey % 3 > 0", "orders")
    return listings.pdf_documents(metadata, files, BASE).select("o_orderkey", "url", "outcome")


def pdf_lane_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _sql(spark, sf_dir, "SELECT o_orderkey, concat('f', o_orderkey) AS file, CASE WHEN o_orderkey % 2 = 0 THEN 'tc' ELSE 'en' END AS lang FROM orders", "orders")
    files = _sql(spark, sf_dir, "SELECT concat('f', o_orderkey) AS file, 'en' AS lane, concat('e', o_orderkey) AS content FROM orders WHERE o_orderkey % 5 > 0 UNION ALL SELECT concat('f', o_orderkey), 'tc', concat('t', o_orderkey) FROM orders WHERE o_orderkey % 3 = 0", "orders")
    return listings.pdf_with_fallback(wanted, files).drop("file")


def live_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, "SELECT o_orderkey, CASE WHEN o_orderkey % 6 > 0 THEN 'u' END AS url, CASE WHEN o_orderkey % 5 = 0 THEN 503 ELSE 200 END AS status, CASE o_orderkey % 4 WHEN 0 THEN '<html>' WHEN 1 THEN '{}' ELSE concat('{\"count\": ', o_orderkey, '}') END AS body FROM orders", "orders")
    count, error = listings.probe_outcome(*(F.col(c) for c in ("url", "status", "body")))
    return rows.select("o_orderkey", count.alias("live_count"), error.alias("probe_error"))


def list_payload_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 404 ELSE 200 END AS status, CASE o_orderkey % 3 WHEN 0 THEN '{\"a\": 1}' WHEN 1 THEN ' [1, 2]' ELSE '[1,' END AS body FROM orders", "orders")
    return rows.select("o_orderkey", listings.list_error(F.col("status"), F.col("body")).alias("error"))


def press_summary_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = "concat('<A class=x href=\"/s/', {n}, '\"><b>Press  Summary</b> (', {lang}, ')</a>')"
    pages = _sql(spark, sf_dir, f"SELECT o_orderkey, concat('<a href=\"/other\">Other</a>', CASE WHEN o_orderkey % 2 = 0 THEN {link.format(n='o_orderkey', lang=chr(39) + 'English' + chr(39))} ELSE '' END, {link.format(n='o_custkey', lang='CASE WHEN o_orderkey % 3 = 0 THEN ' + chr(39) + 'zh-Hant' + chr(39) + ' ELSE ' + chr(39) + 'EN' + chr(39) + ' END')}) AS html FROM orders", "orders")
    return scalars.press_summaries(pages)


def decisions_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every anchor names n, n + 2 to n + 4, a reversed range and a broken part; another file's anchor and a second one of each third
    number stand beside it."""
    said = "concat('aab ', n, ', ', n + 2, '-', n + 4, ', 9-7, 5 6 & ', n + 6, '/2001 (This decision provides Chinese version only)')"
    anchors = _sql(spark, sf_dir, f"SELECT n AS position, concat('files/AAB_', n, '.pdf') AS href, {said} AS text FROM (SELECT s_suppkey * 10 AS n FROM supplier) UNION ALL SELECT 1000000 + s_suppkey, 'x/AAB.pdf', 'AAB 1-2001' FROM supplier UNION ALL SELECT 2000000 + s_suppkey, concat('files/aab_2/x', s_suppkey, '.PDF'), concat('AAB ', s_suppkey * 10, '-2001') FROM supplier WHERE s_suppkey % 3 = 0", "supplier")
    return numbers.decisions(anchors).withColumn("partners", F.array_join(F.transform("partners", lambda p: p["num"].cast("string")), ","))


def resolver_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _sql(spark, sf_dir, "SELECT 2000 AS year, p_partkey AS num, concat('f', p_partkey) AS filename FROM part WHERE p_partkey % 2 = 0", "part")
    rows = _sql(spark, sf_dir, "SELECT p_partkey, 2000 AS year, p_partkey AS num, CASE p_partkey % 3 WHEN 0 THEN concat('Case AAB ', p_partkey + 1, '-2000') WHEN 1 THEN concat('AAB ', p_partkey + 1, '/1999') END AS title FROM part", "part")
    found = numbers.resolved(rows, index, scalars.title_number(F.col("title"), F.col("year")))
    return found.select("p_partkey", "filename", F.when(F.col("filename").isNull(), "failed").otherwise("found").alias("outcome"))


def court_of_docket(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = "CASE o_orderkey % 8 WHEN 0 THEN 'hcmp' WHEN 1 THEN 'CACV' WHEN 2 THEN 'FACC ' WHEN 3 THEN 'DCZZ' WHEN 4 THEN 'HKCFA ' WHEN 5 THEN 'XXXX' WHEN 6 THEN 'HCA-' ELSE 'HCB  ' END"
    return _sql(spark, sf_dir, f"SELECT o_orderkey, concat({prefix}, o_orderkey, '/', year(o_orderdate)) AS docket FROM orders", "orders").select("o_orderkey", scalars.docket_court(F.col("docket")).alias("court"))


_CATEGORY = "CASE p_size % 9 WHEN 0 THEN 'cases' WHEN 1 THEN 'cases-ukpc' WHEN 2 THEN 'legis' WHEN 3 THEN 'legis-hopt' WHEN 4 THEN 'legis-histlaw' WHEN 5 THEN 'other-O' WHEN 6 THEN 'other-P' ELSE 'other-unknown' END"


def endpoint_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, f"SELECT p_partkey, {_CATEGORY} AS category, CASE p_partkey % 3 WHEN 0 THEN 'bacpg' WHEN 1 THEN 'histlaw' ELSE 'hk ts' END AS slug FROM part", "part")
    return rows.select("p_partkey", listings.probe_url(BASE, F.col("category"), F.col("slug"), F.lit("en")).alias("url"), scalars.wire_slug(F.col("slug")).alias("wire"))


def count_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 7 END AS here, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 3 END AS there FROM orders", "orders")
    return rows.select("o_orderkey", scalars.count_cell(F.col("here"), F.col("there")).alias("cell"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, "SELECT event_id, concat('2026-01-01 10:11:12,', event_id % 1000, ' ', CASE event_id % 5 WHEN 0 THEN 'WARNING' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'CRITICAL' ELSE 'INFO' END, ' mod', CASE WHEN event_id % 7 = 0 THEN '' ELSE ':' END, ' said: ', event_id) AS line FROM events", "events")
    return rows.select("event_id", scalars.log_warning(F.col("line")).alias("said"))


def body_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scalars.preview(F.col("text")).alias("preview"), text.error_class(F.substring("text", 1, 90)).alias("error_class"), text.signature(F.substring("text", 1, 30)).alias("signature"))


def markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = "array_join(transform(sort_array(collect_list(struct(s_suppkey, s_name))), x -> concat('| ', x.s_suppkey, ' | ', x.s_name, ' | ', CASE WHEN x.s_suppkey % 2 = 0 THEN '✅' ELSE 'no' END, ' |')), '\\n')"
    texts = _sql(spark, sf_dir, f"SELECT s_nationkey, concat('# list\\n| key | name | open |\\n|---|:--:|--|\\n', {rows}, '\\n| too | few |\\nend') AS said FROM supplier GROUP BY s_nationkey", "supplier")
    return scalars.markdown_rows(texts, "said", ["key", "name", "open"], flag="open").drop("position")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        case_url_parse, case_names, court_listing, statute_listing, pages_read, treaty_listing, secondary_listing, secondary_skipped, privy_listing, privy_document, judgment_payload,
        related_caps_edges, statute_two_hop, history_targets, pdf_two_hop, pdf_lane_fallback, live_probe, list_payload_errors, press_summary_links, decisions_index, resolver_lookup,
        court_of_docket, endpoint_dispatch, count_cells, log_lines, body_previews, markdown_table,
    )
}

_POSITION = "CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT)"
_LISTED = f"SELECT *, count(*) OVER (PARTITION BY o_custkey) AS total, {_POSITION} AS position FROM orders"
_ENTRY = "CASE WHEN o_orderkey % 4 > 0 THEN concat('T', o_orderkey) ELSE '' END AS title, concat('N', o_orderkey) AS neutral, CAST(o_orderdate AS VARCHAR) AS date"
ORACLE_SQL: dict[str, str] = {
    "case_url_parse": f"SELECT o_orderkey, CASE WHEN good THEN 'tc' END AS lang, CASE WHEN good THEN {_COURT} END AS court, CASE WHEN good THEN {_YEAR} END AS year, CASE WHEN good THEN o_orderkey END AS number FROM (SELECT *, o_orderkey % 5 <> 2 AND o_orderkey % 7 <> 0 AS good FROM orders) t",
    "case_names": f"SELECT o_orderkey, concat({_COURT}, '/', {_YEAR}, '/', o_orderkey) AS case_key, concat({_COURT}, '_', {_YEAR}, '_', o_orderkey) AS stem, concat('{BASE}/api/getjudgment?lang=en&abbr=', {_COURT}, '&year=', {_YEAR}, '&num=', o_orderkey) AS url, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS back FROM orders",
    "court_listing": f"SELECT o_custkey, total, position, {_YEAR} AS year, o_orderkey AS number, CASE WHEN o_orderkey % 4 > 0 THEN concat('N', o_orderkey) ELSE '' END AS neutral, CASE WHEN o_orderkey % 3 > 0 THEN concat('T', o_orderkey) ELSE '' END AS title, CAST(o_orderdate AS VARCHAR) AS date FROM ({_LISTED}) t WHERE o_orderkey % 5 > 0",
    "statute_listing": "SELECT p_size, total, position, CAST(p_partkey AS VARCHAR) AS num, CASE WHEN p_partkey % 5 > 0 THEN p_name ELSE '' END AS title, CAST(ceil(total / 10.0) AS INT) AS pages FROM (SELECT *, count(*) OVER (PARTITION BY p_size) AS total, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS INT) AS position FROM part) t WHERE p_partkey % 6 > 0",
    "pages_read": "SELECT o_orderkey, page FROM orders, (VALUES (1), (2), (3)) v(page) WHERE page <= 2 + o_orderkey % 2",
    "treaty_listing": f"SELECT o_custkey, total, position, CASE WHEN o_orderkey % 6 = 0 THEN 'nd' ELSE '1999' END AS year, CAST(o_orderkey AS INT) AS num, {_ENTRY} FROM ({_LISTED}) t WHERE o_orderkey % 6 IN (0, 1)",
    "secondary_listing": f"SELECT o_custkey, total, position, CASE WHEN o_orderkey % 6 = 1 THEN 1999 ELSE 2001 END AS year, CAST(o_orderkey AS INT) AS num, {_ENTRY} FROM ({_LISTED}) t WHERE o_orderkey % 6 IN (1, 2)",
    "secondary_skipped": "SELECT o_custkey, count(*) FILTER (WHERE o_orderkey % 6 NOT IN (1, 2)) AS skipped FROM orders GROUP BY o_custkey",
    "privy_listing": f"SELECT o_custkey, total, position, CASE WHEN o_orderkey % 6 = 3 THEN 1997 ELSE 1998 END AS year, CAST(o_orderkey AS INT) AS num, {_ENTRY} FROM ({_LISTED}) t WHERE o_orderkey % 6 IN (3, 4)",
    "privy_document": "SELECT 'ukpc' AS abbr, CAST(doc_id % 50 + 1950 AS INT) AS year, doc_id AS num, lang, CASE WHEN ok THEN coalesce(source, '') END AS title, CASE WHEN ok THEN '' END AS neutral, CASE WHEN ok THEN '' END AS date, CASE WHEN ok THEN text END AS content, CASE WHEN NOT ok THEN concat('empty content for ukpc/', doc_id % 50 + 1950, '/', doc_id, '/', lang) END AS error FROM (SELECT *, doc_id % 5 > 0 AND doc_id % 7 > 0 AND trim(coalesce(text, '')) <> '' AS ok FROM documents) t",
    "judgment_payload": "SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN coalesce(source, '') ELSE '' END AS title, CASE WHEN doc_id % 3 > 0 THEN CAST(doc_id AS VARCHAR) ELSE '' END AS case_number, coalesce(lang, '') AS court_name, '' AS date, CASE WHEN doc_id % 4 > 0 THEN concat('N', doc_id) ELSE '' END AS neutral, CAST(0 AS INT) AS parallel, coalesce(text, '') AS content, CASE WHEN doc_id % 2 > 0 THEN 'x.doc' END AS doc_url, doc_id % 5 = 1 AS has_translation FROM documents",
    "related_caps_edges": f"SELECT DISTINCT l_partkey AS parent_cap, num AS child_cap, 'en' AS lang, concat('cap ', num) AS title, true AS alpha FROM ({_CAPS}) t WHERE abbr <> 'ord' AND num <> ''",
    "statute_two_hop": "SELECT o_orderkey AS num, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey * 10 END AS vid, CASE WHEN o_orderkey % 5 > 0 THEN '2001-01-01' END AS version_date, CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 3 > 0 THEN concat('toc ', o_orderkey) END AS content, CASE WHEN o_orderkey % 5 = 0 THEN 'no versions returned' WHEN o_orderkey % 3 = 0 THEN 'no table of contents' END AS error FROM orders",
    "history_targets": "SELECT CAST(o_orderkey AS VARCHAR) AS num, o_orderkey * 10 + i AS vid, CASE WHEN i = 1 THEN 'd1' ELSE '' END AS version_date FROM orders, (VALUES (1), (2)) v(i) WHERE o_orderstatus = 'F' AND ((i = 1 AND o_orderkey % 11 = 0) OR (i = 2 AND o_orderkey % 4 > 0))",
    "pdf_two_hop": f"SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN concat('https://other.example/', o_orderkey) WHEN 0 THEN NULL ELSE concat('{BASE}/static/', o_orderkey) END AS url, CASE WHEN o_orderkey % 4 = 0 THEN 'html' WHEN o_orderkey % 3 = 0 THEN 'missing' WHEN o_orderkey % 5 = 0 THEN 'not_pdf' ELSE 'downloaded' END AS outcome FROM orders",
    "pdf_lane_fallback": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'tc' ELSE 'en' END AS lang, CASE WHEN o_orderkey % 6 = 0 THEN concat('t', o_orderkey) WHEN o_orderkey % 5 > 0 THEN concat('e', o_orderkey) END AS content, CASE WHEN o_orderkey % 6 = 0 THEN 'tc' WHEN o_orderkey % 5 > 0 THEN 'en' END AS lane FROM orders",
    "live_probe": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 > 0 AND o_orderkey % 5 > 0 AND o_orderkey % 4 > 0 THEN CASE WHEN o_orderkey % 4 = 1 THEN 0 ELSE o_orderkey END END AS live_count, CASE WHEN o_orderkey % 6 = 0 THEN 'unmapped_endpoint' WHEN o_orderkey % 5 = 0 THEN 'HTTP 503' WHEN o_orderkey % 4 = 0 THEN 'bad JSON' END AS probe_error FROM orders",
    "list_payload_errors": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'HTTP 404' WHEN o_orderkey % 3 <> 1 THEN 'not a JSON list' END AS error FROM orders",
    "press_summary_links": "SELECT o_orderkey, lang, href FROM (SELECT o_orderkey, 'English' AS lang, concat('/s/', CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_custkey END) AS href FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 > 0 UNION ALL SELECT o_orderkey, 'Chinese', concat('/s/', o_custkey) FROM orders WHERE o_orderkey % 3 = 0) t",
    "decisions_index": "SELECT 2001 AS year, n + i AS num, CASE WHEN i = 0 AND n % 30 = 0 THEN concat('x', n // 10, '.PDF') ELSE concat('AAB_', n, '.pdf') END AS filename, NOT (i = 0 AND n % 30 = 0) AS chinese_only, CASE WHEN i = 0 AND n % 30 = 0 THEN '' ELSE (SELECT string_agg(CAST(n + j AS VARCHAR), ',' ORDER BY j) FROM (VALUES (0), (2), (3), (4), (6)) w(j) WHERE j <> i) END AS partners FROM (SELECT s_suppkey * 10 AS n FROM supplier) t, (VALUES (0), (2), (3), (4), (6)) v(i)",
    "resolver_lookup": "SELECT p_partkey, f AS filename, CASE WHEN f IS NULL THEN 'failed' ELSE 'found' END AS outcome FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('f', p_partkey) WHEN p_partkey % 3 = 0 AND p_partkey + 1 <= (SELECT max(p_partkey) FROM part) THEN concat('f', p_partkey + 1) END AS f FROM part) t",
    "court_of_docket": "SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'hkcfi' WHEN 1 THEN 'hkca' WHEN 2 THEN 'hkcfa' WHEN 3 THEN 'hkdc' WHEN 4 THEN 'hkcfa' WHEN 7 THEN 'hkcfi' END AS court FROM orders",
    "endpoint_dispatch": f"SELECT p_partkey, concat('{BASE}/api/', CASE p_size % 9 WHEN 0 THEN 'getmetacase?caseDb=' WHEN 1 THEN 'getmetahopt?dbcat=C&abbr=' WHEN 2 THEN 'getmetalegis?cap_type=' WHEN 3 THEN 'getmetahopt?dbcat=other&abbr=' WHEN 4 THEN 'getmetahopt?dbcat=H&abbr=' WHEN 5 THEN 'getmetahopt?dbcat=O&abbr=' WHEN 6 THEN 'getmetahopt?dbcat=P&abbr=' END || CASE p_partkey % 3 WHEN 0 THEN 'bacpg' WHEN 1 THEN 'histlaw' ELSE 'hk+ts' END || '&lang=en') AS url, CASE p_partkey % 3 WHEN 0 THEN 'hktba' WHEN 1 THEN 'hkhistlaws' ELSE 'hk ts' END AS wire FROM part WHERE p_size % 9 < 7 UNION ALL SELECT p_partkey, NULL, CASE p_partkey % 3 WHEN 0 THEN 'hktba' WHEN 1 THEN 'hkhistlaws' ELSE 'hk ts' END FROM part WHERE p_size % 9 >= 7",
    "count_cells": "SELECT o_orderkey, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND a <> b THEN '**' || a || ' / ' || b || ' (' || CASE WHEN b > a THEN '+' ELSE '' END || (b - a) || ')**' ELSE coalesce(CAST(a AS VARCHAR), '—') || ' / ' || coalesce(CAST(b AS VARCHAR), '—') END AS cell FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 7 END AS a, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 3 END AS b FROM orders) t",
    "log_lines": "SELECT event_id, CASE WHEN event_id % 5 < 3 THEN CASE WHEN event_id % 7 = 0 THEN concat('[10:11:12] ', event_id) ELSE concat('[10:11:12] said: ', event_id) END END AS said FROM events",
    "body_previews": "SELECT doc_id, replace(substr(text, 1, 200), chr(10), ' ') AS preview, substr(trim(string_split_regex(substr(text, 1, 90), '[:;,]')[1]), 1, 60) AS error_class, coalesce(nullif(trim(regexp_replace(substr(text, 1, 30), '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'sample') AS signature FROM documents",
    "markdown_table": "SELECT s_nationkey, CAST(s_suppkey AS VARCHAR) AS key, s_name AS name, s_suppkey % 2 = 0 AS open FROM supplier",
}
