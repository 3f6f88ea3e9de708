"""The ledger's tables as SQL over the driver tables, shared by every plan; each plan names the ones that it needs."""

FACADES: dict[str, tuple[tuple[str, ...], str]] = {
    "cases": (("orders",), """
        SELECT concat('c', CAST(o_custkey % 12 AS STRING)) AS court, CAST(year(o_orderdate) AS INT) AS yr, o_orderkey AS number, o_orderdate AS dt,
               CASE o_orderstatus WHEN 'F' THEN 'downloaded' WHEN 'P' THEN 'failed' ELSE 'pending' END AS status,
               CASE WHEN o_orderkey % 5 = 0 THEN 'tc' ELSE 'en' END AS lang,
               CASE WHEN o_orderstatus = 'P' THEN concat('HTTP ', CAST(500 + o_custkey % 5 AS STRING), ' after 3 retries; body: x') END AS error,
               o_custkey AS custkey, o_totalprice AS price
        FROM orders"""),
    "citations": (("lineitem",), """
        SELECT l_orderkey AS from_key, l_partkey AS to_key, l_returnflag AS citer_lang, CAST(l_quantity AS INT) AS citer_freq, l_linenumber AS position
        FROM lineitem"""),
    "log": (("events",), """
        SELECT event_id, ts, user_id AS proxy, value AS elapsed_ms, props,
               CASE event_type WHEN 'view' THEN 'request_success' WHEN 'error' THEN 'request_failed' WHEN 'purchase' THEN 'challenge_detected'
                               WHEN 'click' THEN 'warmup' ELSE 'pool_exhausted' END AS kind
        FROM events"""),
    "bodies": (("documents", "labels"), """
        SELECT d.doc_id, d.text, d.lang, d.source, CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN l.quality = 1 THEN 'downloaded' ELSE 'failed' END AS enrichment
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""),
    "versions": (("conversations",), "SELECT conv_id AS doc, turn AS vid, role, text FROM conversations"),
    "freshness": (("nation", "customer", "supplier"), """
        SELECT n.n_nationkey AS scope, g.lang, n.n_regionkey AS kind, c.live_count, s.local_count, 19000 + n.n_nationkey % 3 AS live_day,
               CASE WHEN n.n_nationkey % 7 = 0 THEN NULL ELSE 19001 END AS scrape_day, 1000 + n.n_nationkey AS probed_at, 1010 AS scraped_at,
               CASE WHEN n.n_nationkey % 11 = 3 THEN 'timeout' END AS probe_error
        FROM nation n CROSS JOIN (SELECT 'en' AS lang UNION ALL SELECT 'tc') g
        LEFT JOIN (SELECT c_nationkey, count(*) % 3 AS live_count FROM customer GROUP BY c_nationkey) c ON c.c_nationkey = n.n_nationkey
        LEFT JOIN (SELECT s_nationkey, count(*) % 3 AS local_count FROM supplier GROUP BY s_nationkey) s ON s.s_nationkey = n.n_nationkey
        WHERE NOT (n.n_nationkey % 6 = 5 AND g.lang = 'tc')"""),
    "expected": (("nation",), "SELECT n_nationkey AS scope, lang FROM nation CROSS JOIN (SELECT 'en' AS lang UNION ALL SELECT 'tc') g"),
    "delta": (("orders",), """
        SELECT concat('c', CAST(o_custkey % 12 AS STRING)) AS court, o_orderkey AS number, concat('n', CAST(o_orderkey AS STRING)) AS title,
               CASE WHEN o_orderkey % 2 = 0 THEN 'en' ELSE 'tc' END AS lang, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey + 7 END AS seen
        FROM orders WHERE o_orderkey % 3 = 0"""),
    "state": (("orders",), """
        SELECT concat('c', CAST(o_custkey % 12 AS STRING)) AS court, o_orderkey AS number, concat('o', CAST(o_orderkey AS STRING)) AS title,
               CASE WHEN o_orderkey % 5 = 0 THEN 'tc' ELSE 'en' END AS lang, o_orderkey AS seen,
               CASE o_orderstatus WHEN 'F' THEN 'downloaded' WHEN 'P' THEN 'failed' ELSE 'pending' END AS status
        FROM orders WHERE o_orderkey % 7 <> 0"""),
}


def with_facades(body: str, *names: str) -> tuple[str, tuple[str, ...]]:
    """The body with the named facades before it, and the driver tables that they read."""
    parts = ", ".join(f"{n} AS ({FACADES[n][1]})" for n in names)
    return f"WITH {parts} {body}" if names else body, tuple(dict.fromkeys(t for n in names for t in FACADES[n][0]))
