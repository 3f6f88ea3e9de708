"""Status counts, queues, state merges and marks of the ledger, as plans over facades: name -> (facades, SQL)."""


PLANS: dict[str, tuple[tuple[str, ...], str]] = {
    "status_counts": (("cases",), """SELECT count(*) AS total, sum(CASE WHEN status = 'pending' THEN 1 ELSE 0 END) AS pending, sum(CASE WHEN status = 'in_progress' THEN 1 ELSE 0 END) AS in_progress,
        sum(CASE WHEN status = 'downloaded' THEN 1 ELSE 0 END) AS downloaded, sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS failed FROM cases"""),
    "status_by_court": (("cases",), "SELECT court, status, count(*) AS n FROM cases GROUP BY court, status"),
    "scope_status_pivot": (("cases",), """SELECT court, sum(CASE WHEN status = 'pending' THEN 1 ELSE 0 END) AS pending, sum(CASE WHEN status = 'downloaded' THEN 1 ELSE 0 END) AS downloaded,
        sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS failed FROM cases GROUP BY court"""),
    "error_class_counts": (("cases",), "SELECT error_class, count(*) AS n FROM (SELECT substr(trim(regexp_replace(error, '(?s)[:;,].*$', '')), 1, 60) AS error_class FROM cases WHERE error IS NOT NULL) t GROUP BY error_class"),
    "orphan_candidates": (("state",), "SELECT court, number FROM state WHERE status = 'downloaded' AND (seen IS NULL OR seen < 3000)"),
    "last_enumeration": (("state",), "SELECT court, max(seen) AS last_seen, min(seen) AS first_seen FROM state GROUP BY court"),
    "distinct_keys": (("cases",), "SELECT count(*) AS n FROM (SELECT DISTINCT court, yr, number FROM cases) t"),
}
