"""State kept in buckets, counts kept by deltas, pages read by a tokenizer, JSON held against schemas, headers compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import html, numbers
from lexmill.operators import hub_cache, schemas, stats
from lexmill.plans import rules
from lexmill.session import table, views, working_path
from lexmill.sources import buckets

#: The log's events, each kind with what it needs; and a judgment's facts.
EVENT_SCHEMA = {
    "type": "object",
    "required": ["ts", "kind"],
    "unevaluatedProperties": False,
    "properties": {"ts": {"type": "string"}, "kind": {"type": "string"}, "extra": {"type": "object", "additionalProperties": True}},
    "oneOf": [
        {"properties": {"kind": {"const": "request_success"}, "url": {"type": "string"}, "http_status": {"type": "integer"}, "elapsed_ms": {"type": "number"}}, "required": ["kind", "url", "http_status", "elapsed_ms"]},
        {"properties": {"kind": {"const": "request_failed"}, "url": {"type": "string"}, "error_class": {"type": "string"}}, "required": ["kind", "url"]},
        {"properties": {"kind": {"const": "warmup"}, "proxy_url": {"type": "string"}}, "required": ["kind", "proxy_url"]},
    ],
}
FACTS_SCHEMA = {
    "type": "object",
    "additionalProperties": False,
    "required": ["title", "lang", "parallel", "doc_url", "has_translation"],
    "properties": {
        "title": {"type": "string"},
        "lang": {"enum": ["en", "tc"]},
        "parallel": {"type": "array", "items": {"type": "string"}, "minItems": 1},
        "doc_url": {"type": ["string", "null"]},
        "has_translation": {"type": "boolean"},
        "year": {"type": "integer", "minimum": 1843},
    },
}


def _sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    views(spark, sf_dir, *tables)
    return spark.sql(text)


def bucketed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of ``upsert_case_merge`` in buckets, its delta merged into the slots that it touches."""
    path = working_path(spark, "case-state")
    old, delta = rules._both(spark, sf_dir)
    buckets.create(old.drop("formats"), path, ["court", "number"], slots=4, buckets=4)
    buckets.upsert(spark, path, delta, {"title": "new", "lang": "english_wins", "seen": "new"})
    return buckets.state(spark, path).withColumn("status", F.coalesce("status", F.lit("pending"))).select("court", "number", "title", "lang", "seen", "status")


def hub_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deltas of edges, of which each third order comes in all: as many inbound as a full count gives."""
    path, edges = working_path(spark, "hubs"), rules._edges(spark, sf_dir).select("from_key", "to_key")
    hub_cache.create(spark, path, edges, slots=2, parts=hub_cache.parts_for(edges.count()))
    for n in range(3):
        hub_cache.add(spark, path, edges.where((F.col("from_key") % 4 == n) | (F.col("from_key") % 3 == 0)))
    return hub_cache.hubs(spark, path)


_MATRIX_PAGE = """SELECT page_id, concat(html, '<a class=x HREF=/en/cases/s', page_id % 9, '>x</a><p><a href=''/tc/cases/s', page_id % 9, '/''><b>y</b></a>', CASE WHEN page_id % 2 = 0 THEN concat('<a
    title="a > b" href="&#47;sc/legis/l-', page_id % 5, '/list">z') ELSE '<script>var a = "<a href=''/en/other/none''>"</script>' END, '<!-- <a href="/en/other/no">n</a> --><a name=top>t</a><a href="/en/cases/S1">u</a>') AS html FROM pages"""


def database_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors with single quotes, none, a line break or a reference inside, added to every page; comments and scripts hold none."""
    return html.database_matrix(_sql(spark, sf_dir, _MATRIX_PAGE, "pages")).withColumn("langs", F.array_join("langs", ","))


_INDEX_PAGE = """SELECT page_id, concat(html, '<td><a href=files/AAB_', page_id, '.pdf><b>AAB</b> ', page_id * 10, ' &amp; ', page_id * 10 + 2, '/2001</a></td><a href=''files/aab_', page_id, 'b.PDF''>AAB ', page_id * 10 + 5, '-2002 <i>(This decision provides Chinese version only)</i></a>
    <a href="files/AAB_lost.pdf">AAB 1/1999 <a href="files/other.pdf">AAB 7/1999</a>', CASE WHEN page_id % 3 = 0 THEN '<a href="files/AAB_open.pdf">AAB 3/1998' ELSE '' END) AS html FROM pages"""


def decisions_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's own decisions: pages in the place of one index, each with its numbers."""
    found = html.decision_anchors(_sql(spark, sf_dir, _INDEX_PAGE, "pages")).withColumn("position", F.struct("page_id", "position"))
    return numbers.decisions(found).withColumn("partners", F.array_join(F.transform("partners", lambda p: p["num"].cast("string")), ","))


_LINES = """SELECT event_id, CASE event_id % 8 WHEN 0 THEN '{"ts": 5, "kind": "warmup", "proxy_url": "p"}' WHEN 1 THEN '{"ts": "t", "kind": "request_success", "url": "u", "http_status": 200.5, "elapsed_ms": "1"}'
    WHEN 2 THEN '{"ts": "t", "kind": "request_failed", "url": "u", "proxy_url": "p", "extra": {"a": [1]}}' WHEN 3 THEN '{"ts": "t", "kind": "strange"}' WHEN 4 THEN '{"kind": "warmup", "proxy_url": null}'
    WHEN 5 THEN '[1' WHEN 6 THEN '{"ts": "t", "kind": "request_success", "url": "u", "http_status": 2.0, "elapsed_ms": 1}' ELSE '"kind"' END AS line FROM events"""


def event_schema_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.json_faults(_sql(spark, sf_dir, _LINES, "events"), EVENT_SCHEMA)


_FACTS = """SELECT o_orderkey, concat('{"title": ', CASE WHEN o_orderkey % 2 = 0 THEN '"t"' ELSE 'null' END, ', "lang": "', CASE o_orderkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'tc' ELSE 'fr' END, '", "doc_url": null, "year": ', 1840 + o_orderkey % 5, ', "parallel": ',
    CASE o_orderkey % 7 WHEN 0 THEN '[]' WHEN 1 THEN '["a", 1, 2]' WHEN 2 THEN '{}' ELSE '["a"]' END, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE ', "has_translation": true' END, CASE WHEN o_orderkey % 13 = 0 THEN ', "more": 1' ELSE '' END, '}') AS line FROM orders"""


def file_schema_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.json_faults(_sql(spark, sf_dir, _FACTS, "orders"), FACTS_SCHEMA)


_ANSWERS = """SELECT event_id, user_id, ts, CASE WHEN event_id % 5 > 0 THEN map_concat(map('Server', concat('s', event_id % 2)), CASE WHEN event_id % 3 = 0 THEN map('CF-Ray', 'r') ELSE map() END) END AS headers FROM events"""


def header_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How answers differ from the one before them of the same user."""
    rows = stats.header_drift(_sql(spark, sf_dir, _ANSWERS, "events"), ["user_id"], ["ts", "event_id"])
    return rows.select("event_id", "name", "change", "old", "new")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (bucketed_upsert, hub_deltas, database_matrix, decisions_page, event_schema_faults, file_schema_faults, header_drift)}

_PAIRED = "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events"
_S, _C = ("CASE WHEN {0} % 5 > 0 THEN concat('s', {0} % 2) END", "CASE WHEN {0} % 15 IN (3, 6, 9, 12) THEN 'r' END")
ORACLE_SQL: dict[str, str] = {
    "bucketed_upsert": rules.ORACLE_SQL["upsert_case_merge"],
    "hub_deltas": "SELECT l_partkey AS to_key, count(DISTINCT l_orderkey) AS inbound FROM lineitem WHERE l_orderkey % 4 < 3 OR l_orderkey % 3 = 0 GROUP BY l_partkey",
    "database_matrix": "SELECT 'cases' AS category, concat('s', page_id % 9) AS slug, 'en,tc' AS langs FROM pages GROUP BY ALL UNION ALL SELECT DISTINCT 'legis', concat('l-', page_id % 5), 'sc' FROM pages WHERE page_id % 2 = 0",
    "decisions_page": "SELECT CASE WHEN i = 5 THEN 2002 ELSE 2001 END AS year, CAST(page_id * 10 + i AS BIGINT) AS num, CASE WHEN i = 5 THEN concat('aab_', page_id, 'b.PDF') ELSE concat('AAB_', page_id, '.pdf') END AS filename, i = 5 AS chinese_only, CASE i WHEN 0 THEN CAST(page_id * 10 + 2 AS VARCHAR) WHEN 2 THEN CAST(page_id * 10 AS VARCHAR) ELSE '' END AS partners FROM pages, (VALUES (0), (2), (5)) v(i) UNION ALL SELECT 1999, 1, 'AAB_lost.pdf', false, '' WHERE false",
    "event_schema_faults": """SELECT event_id, fault FROM events JOIN (VALUES (0, '$.ts: not string'), (1, '$.http_status: not integer'), (1, '$.elapsed_ms: not number'), (2, '$.proxy_url: not allowed'), (3, '$.kind: unknown'), (4, '$: lacks ts'), (4, '$.proxy_url: not string'), (5, 'not JSON'), (7, '$: not object')) v(k, fault) ON k = event_id % 8""",
    "file_schema_faults": """SELECT o_orderkey, '$.title: not string' AS fault FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT o_orderkey, '$.lang: none of ["en", "tc"]' FROM orders WHERE o_orderkey % 3 = 2 UNION ALL SELECT o_orderkey, '$.year: minimum 1843' FROM orders WHERE o_orderkey % 5 < 3
        UNION ALL SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN '$.parallel: under 1 items' WHEN 1 THEN '$.parallel[]: not string' ELSE '$.parallel: not array' END FROM orders WHERE o_orderkey % 7 < 3
        UNION ALL SELECT o_orderkey, '$: lacks has_translation' FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT o_orderkey, '$.more: not allowed' FROM orders WHERE o_orderkey % 13 = 0""",
    "header_drift": f"SELECT event_id, name, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'gone' ELSE 'changed' END AS change, old, new FROM (SELECT event_id, 'server' AS name, {_S.format('b')} AS old, {_S.format('event_id')} AS new FROM ({_PAIRED}) p WHERE b IS NOT NULL UNION ALL SELECT event_id, 'cf-ray', {_C.format('b')}, {_C.format('event_id')} FROM ({_PAIRED}) q WHERE b IS NOT NULL) t WHERE old IS DISTINCT FROM new",
}
