"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from lexmill.session import session

HEADLINE = (
    "status_by_court", "scope_status_pivot", "upsert_case_merge", "insert_or_ignore_edges", "kind_counts_window", "hot_proxies",
    "hourly_trajectory", "event_faults", "fresh_rule", "freshness_cells", "validator_presence", "validator_enrichment", "hub_cases",
    "cited_by", "shared_partners", "body_dedup",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session("bench", cores=os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    from lexmill.registry import QUERIES

    QUERIES["status_by_court"](spark, folder).collect()  # starts the session's machinery
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
