"""Reconciliation of bodies with state, extraction from pages and versions, and the citation graph."""

PLANS: dict[str, tuple[tuple[str, ...], str]] = {
    "snapshot_diff": (("versions",), "SELECT doc FROM versions WHERE vid = 1 EXCEPT SELECT doc FROM versions WHERE vid = 3"),
    "body_dedup": (("bodies",), "SELECT h AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM (SELECT doc_id, sha256(text) AS h FROM bodies) t GROUP BY h HAVING count(*) > 1"),
    "cited_by": (("citations",), "SELECT to_key, count(DISTINCT from_key) AS citers, sum(citer_freq) AS mentions FROM citations GROUP BY to_key"),
    "edge_bidirectional": (("citations",), "SELECT DISTINCT from_key, to_key FROM citations"),
}
EXTRA_TABLES: dict[str, tuple[str, ...]] = {}
