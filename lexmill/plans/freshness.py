"""Bucket freshness: the FRESH predicate with all its conjuncts, reasons, scopes and divergence."""

FRESH = """coalesce(probe_error IS NULL AND live_count IS NOT NULL AND local_count IS NOT NULL AND live_count = local_count AND scrape_day IS NOT NULL
    AND live_day <= scrape_day AND (live_day < scrape_day OR (probed_at IS NOT NULL AND probed_at <= scraped_at)), false)"""

PLANS: dict[str, tuple[tuple[str, ...], str]] = {
    "fresh_predicate": (("freshness",), f"SELECT scope, lang, {FRESH} AS fresh FROM freshness"),
    "stale_reason": (("freshness",), f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN {FRESH} THEN 'fresh' WHEN probe_error IS NOT NULL THEN 'probe error' WHEN live_count IS NULL THEN 'no live count' WHEN local_count IS NULL THEN 'no local count' WHEN live_count <> local_count THEN 'counts differ' WHEN scrape_day IS NULL THEN 'never scraped' WHEN live_day > scrape_day THEN 'live is newer' ELSE 'probed after scrape' END AS reason FROM freshness) t GROUP BY reason"),
    "stale_buckets": (("freshness",), f"SELECT scope, lang FROM freshness WHERE NOT {FRESH}"),
    "first_run_missing": (("expected", "freshness"), "SELECT e.scope, e.lang FROM expected e LEFT JOIN freshness f ON e.scope = f.scope AND e.lang = f.lang WHERE f.scope IS NULL"),
    "coverage_containment": (("expected", "freshness"), "SELECT count(*) AS uncovered FROM (SELECT scope, lang FROM expected EXCEPT SELECT scope, lang FROM freshness) t"),
    "stale_or_missing": (("expected", "freshness"), f"SELECT scope, lang FROM freshness WHERE NOT {FRESH} UNION SELECT e.scope, e.lang FROM expected e LEFT JOIN freshness f ON e.scope = f.scope AND e.lang = f.lang WHERE f.scope IS NULL"),
    "expected_triples": (("expected",), "SELECT scope, lang FROM expected"),
}
