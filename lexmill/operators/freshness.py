"""Whether a bucket of the corpus is fresh, and why it is not.

ledger: kind, scope, lang, probe_error, live_count, local_count, live_updated_at (text YYYY-MM-DD), live_probed_at and
last_scrape_completed_at (seconds since 1970, UTC).  Dates of stamps are civil dates in Hong Kong; the session's zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZONE = "Asia/Hong_Kong"


def civil_date(seconds: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(seconds), ZONE))


def fresh() -> Column:
    """All rules hold; anything unknown, and a date that is none, is stale.  On the day of the scrape itself the count must have been
    seen before the scrape ended."""
    live = F.col("live_updated_at").try_cast("date")
    scraped = civil_date(F.col("last_scrape_completed_at"))
    seen_before = F.col("live_probed_at") <= F.col("last_scrape_completed_at")
    return F.coalesce(F.col("probe_error").isNull() & (F.col("live_count") == F.col("local_count")) & ((live < scraped) | (live == scraped) & seen_before), F.lit(False))


def stale_reason() -> Column:
    """The first rule that fails, in words; dates are compared as texts, and the order within a day is not looked at."""
    scraped = civil_date(F.col("last_scrape_completed_at")).cast("string")
    return (
        F.when(F.col("probe_error").isNotNull(), "probe error")
        .when(F.col("live_count").isNull(), "no live count")
        .when(F.col("local_count").isNull(), "no local count")
        .when(F.col("live_count") != F.col("local_count"), "counts differ")
        .when(scraped.isNull(), "never scraped")
        .when(F.col("live_updated_at").isNull(), "no live date")
        .when(F.col("live_updated_at") > scraped, "updated since")
        .otherwise("fresh")
    )


def summary(ledger: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: probed, healthy (no error), fresh, stale, and expected buckets (kind, scope, lang) that have no row yet."""
    row = ledger.agg(F.count("live_probed_at").alias("probed"), F.count_if(F.col("live_probed_at").isNotNull() & F.col("probe_error").isNull()).alias("healthy"), F.count_if(fresh()).alias("fresh"), F.count_if(~fresh()).alias("stale"))
    return row.crossJoin(F.broadcast(expected.join(ledger, ["kind", "scope", "lang"], "left_anti").agg(F.count(F.lit(1)).alias("first_run"))))
