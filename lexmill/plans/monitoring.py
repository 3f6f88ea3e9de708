"""Event-log analytics: windows, outliers, alert rules and triage recipes. ``now`` is the newest event."""

_NOW = "(SELECT max(ts) FROM log)"
_FAIL = "kind IN ('request_failed', 'challenge_detected')"

PLANS: dict[str, tuple[tuple[str, ...], str]] = {
    "kind_counts_window": (("log",), f"SELECT k.kind, count(w.kind) AS n FROM (SELECT 'request_success' AS kind UNION ALL SELECT 'request_failed' UNION ALL SELECT 'challenge_detected' UNION ALL SELECT 'warmup' UNION ALL SELECT 'pool_exhausted' UNION ALL SELECT 'ip_echo') k LEFT JOIN (SELECT kind FROM log WHERE ts >= {_NOW} - INTERVAL 1 DAY) w ON k.kind = w.kind GROUP BY k.kind"),
    "proxy_success_rate": (("log",), "SELECT proxy, sum(CASE WHEN kind = 'request_success' THEN 1 ELSE 0 END) AS ok, count(*) AS total, CAST(floor(100.0 * sum(CASE WHEN kind = 'request_success' THEN 1 ELSE 0 END) / count(*)) AS INT) AS pct FROM log GROUP BY proxy"),
    "hourly_trajectory": (("log",), f"SELECT date_trunc('hour', ts) AS hr, count(*) AS requests, sum(CASE WHEN {_FAIL} THEN 1 ELSE 0 END) AS failures FROM log GROUP BY date_trunc('hour', ts)"),
    "challenges_by_proxy": (("log",), "SELECT coalesce(CAST(proxy AS STRING), 'unknown') AS proxy, count(*) AS n FROM log WHERE kind = 'challenge_detected' GROUP BY coalesce(CAST(proxy AS STRING), 'unknown')"),
    "retry_depth": (("log",), "SELECT props, count(*) AS n FROM log WHERE kind = 'request_failed' GROUP BY props"),
    "recent_challenges": (("log",), "SELECT event_id, proxy FROM log WHERE kind = 'challenge_detected' ORDER BY ts DESC, event_id DESC LIMIT 5"),
}
