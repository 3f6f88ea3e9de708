"""Queues of the ledger with the reference's defaults: no limit and all courts, unless a caller asks for less.

cases has court, yr, number and status; recheck_queue also reads dt (the case's date) and pending_stamp."""

from __future__ import annotations

import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _limited(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows.limit(limit) if limit is not None and limit > 0 else rows


def recheck_queue(cases: DataFrame, limit: int | None = None, max_age_days: int | None = None, today: datetime.date | None = None) -> DataFrame:
    """Downloaded cases with a pending stamp, oldest stamp first; none or 0 for limit or age means all.  Dates that are not
    ISO ones (less than '1000') pass the age; null dates do not, as in the reference's SQL."""
    rows = cases.where((F.col("status") == "downloaded") & F.col("pending_stamp").isNotNull())
    if max_age_days is not None and max_age_days > 0:
        cutoff = (today or datetime.datetime.now(ZoneInfo("Asia/Hong_Kong")).date()) - datetime.timedelta(days=max_age_days)
        day = F.substring(F.col("dt").cast("string"), 1, 10)
        rows = rows.where((day >= cutoff.isoformat()) | (day < "1000"))
    return _limited(rows.orderBy("pending_stamp", "court", "yr", "number"), limit)


def pending_cases(cases: DataFrame, courts: list[str] | None = None) -> DataFrame:
    """Pending cases of these courts; of all where none are named."""
    rows = cases.where(F.col("status") == "pending")
    return rows.where(F.col("court").isin(*courts)) if courts else rows


def claim_batch(cases: DataFrame, limit: int | None = None) -> DataFrame:
    """The whole pending set as one batch in progress."""
    return _limited(pending_cases(cases).orderBy("court", "yr", "number"), limit).withColumn("status", F.lit("in_progress"))


def pending_enrichment(cases: DataFrame, kinds: list[str], courts: list[str] | None = None) -> DataFrame:
    """Downloaded cases with a pending status of any of these kinds (summary_en, summary_zh, appeal_history); none: no rows."""
    pending = F.exists(F.array(*(F.col(f"{k}_status") for k in kinds)), lambda s: F.coalesce(s == "pending", F.lit(False))) if kinds else F.lit(False)
    rows = cases.where((F.col("status") == "downloaded") & pending)
    return rows.where(F.col("court").isin(*courts)) if courts else rows


def pending_generation(cases: DataFrame, limit: int | None = None, include_failed: bool = False) -> DataFrame:
    """Downloaded cases whose only format is doc and that have no page made from it; those that failed only if they are asked for."""
    rows = cases.where((F.col("status") == "downloaded") & (F.col("formats") == F.array(F.lit("doc"))) & F.col("html_from").isNull())
    rows = rows if include_failed else rows.where(F.col("html_error").isNull())
    return rows if limit is None else rows.orderBy("court", "year", "number").limit(limit)


def pending_versions(versions: DataFrame) -> DataFrame:
    return versions.where("status = 'pending'")


def downloaded(cases: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Those of wanted (keys) that are downloaded, as one semi join in place of a lookup for each row."""
    return wanted.join(cases.where("status = 'downloaded'"), keys, "left_semi")


def not_downloaded(listing: DataFrame, rows: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """What of a listing is still to be fetched; all of it with force."""
    return listing if force else listing.join(rows.where("status = 'downloaded'"), keys, "left_anti")


def enumerated_lately(cases: DataFrame, hours: float, now: int) -> DataFrame:
    """(court) of those that were listed within so many hours, which a run skips; the language does not matter."""
    return cases.groupBy("court").agg(F.max("last_seen").alias("last")).where(F.lit(now) - F.col("last") < hours * 3600).select("court")


def fetch_queue(cases: DataFrame, fetches: DataFrame, keys: list[str]) -> DataFrame:
    """fetches with a pending row for each downloaded case that has none; rows that are there stay as they are."""
    new = cases.where("status = 'downloaded'").select(*keys).distinct().join(fetches, keys, "left_anti").withColumn("status", F.lit("pending"))
    return fetches.unionByName(new, allowMissingColumns=True)


def cap_grid(fetches: DataFrame, low: int, high: int, abbrs: list[str], langs: list[str]) -> DataFrame:
    """fetches with a pending row for each cap from low up to high (itself not), abbreviation and language that has none."""
    spark = fetches.sparkSession
    grid = spark.range(low, high).select(F.col("id").cast("string").alias("cap"), F.explode(F.array(*map(F.lit, abbrs))).alias("abbr")).select("cap", "abbr", F.explode(F.array(*map(F.lit, langs))).alias("lang"))
    return fetches.unionByName(grid.join(fetches, ["cap", "abbr", "lang"], "left_anti").withColumn("status", F.lit("pending")), allowMissingColumns=True)


def buckets(rows: DataFrame, kinds: list[str] | None = None, scopes: list[str] | None = None, langs: list[str] | None = None) -> DataFrame:
    """Buckets of these kinds, scopes and languages; an empty filter lets all through."""
    for column, values in (("kind", kinds), ("scope", scopes), ("lang", langs)):
        rows = rows.where(F.col(column).isin(*values)) if values else rows
    return rows


def narrow(min_date: str | None, max_date: str | None) -> bool:
    """Whether a listing's window has a bound."""
    return min_date is not None or max_date is not None


def first_in_group(rows: DataFrame, group: str, order: str, n: int | None, wanted: list[str] | None = None) -> DataFrame:
    """The first n rows of each group in their own order (None: all), with place; of the wanted groups in the order asked for (rank)."""
    if n is not None:
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("place") <= n)
    else:
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    if wanted is None:
        return rows.withColumn("rank", F.lit(0))
    ranks = F.create_map(*(F.lit(x) for i, g in enumerate(wanted) for x in (g, i))) if wanted else F.lit(None).cast("map<string,int>")
    return rows.withColumn("rank", F.try_element_at(ranks, F.col(group))).where("rank is not null")
