"""Counts over the ledger, zero-filled, and checks of logs and listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that an event of a kind must have; all may have the others.
REQUIRED = {
    "request_success": ("url", "elapsed_ms"), "request_failed": ("url", "error_class"), "challenge_detected": ("url", "proxy"), "warmup": ("proxy",),
    "pool_exhausted": (), "degraded": (), "ip_echo": ("proxy",),
}


def by_status(rows: DataFrame, statuses: Sequence[str], by: Sequence[str] = (), column: str = "status") -> DataFrame:
    """total and a count for each of the statuses, of all rows or by columns; rows of other statuses count in total alone."""
    counts = [F.count(F.lit(1)).alias("total"), *(F.count_if(F.coalesce(F.col(column) == s, F.lit(False))).alias(s) for s in statuses)]
    return rows.groupBy(*by).agg(*counts) if by else rows.agg(*counts)


def scoped(rows: DataFrame, column: str, values: Sequence[str] | None) -> DataFrame:
    """Rows of these values; None lets all through, and no values none."""
    return rows if values is None else rows.where(F.col(column).isin(*values)) if values else rows.limit(0)


def enrichment(cases: DataFrame, kinds: Sequence[str], statuses: Sequence[str]) -> DataFrame:
    """(kind, a count for each status): a row for each kind."""
    long = cases.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{k}_status").alias("state")) for k in kinds))).alias("e")).select("e.*")
    return by_status(long, statuses, ["kind"], "state").drop("total")


def generated(cases: DataFrame) -> DataFrame:
    """(source, n): pages made of documents by what they were made of, and those that failed and are pending, among downloaded cases
    whose only format is doc."""
    scope = cases.where((F.col("status") == "downloaded") & (F.col("formats") == F.array(F.lit("doc"))))
    source = F.coalesce("html_from", F.when(F.col("html_error").isNotNull(), "failed").otherwise("pending"))
    return scope.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n"))


def local_counts(cases: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(scope, lang, n): downloaded cases; Chinese ones and the Chinese sidecars (scope, n) of other cases count together."""
    own = cases.where("status = 'downloaded'").groupBy(F.col("court").alias("scope"), "lang").agg(F.count(F.lit(1)).alias("n"))
    return own.unionByName(sidecars.select("scope", F.lit("tc").alias("lang"), "n")).groupBy("scope", "lang").agg(F.sum("n").alias("n"))


def sidecars(files: DataFrame, suffix: str = ".tc.json") -> DataFrame:
    """(scope, n): files of a suffix by their first folder."""
    return files.where(F.col("path").endswith(suffix)).groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("scope")).agg(F.count(F.lit(1)).alias("n"))


def header_fingerprint(headers: Column) -> Column:
    """Which server answered: server, else content-type, else ?; header names in lower case."""
    return F.coalesce(F.try_element_at(headers, F.lit("server")), F.try_element_at(headers, F.lit("content-type")), F.lit("?"))


def header_changes(old: Column, new: Column) -> Column:
    """Which headers differ, as array<struct<name, change, old, new>> by name: added, gone or changed.  Names count in lower case; of
    several that then are one the last in order counts.  A null map has no headers, and a null value is a value."""

    def names(headers: Column) -> Column:
        return F.array_distinct(F.transform(F.map_keys(headers), F.lower))

    def last(headers: Column, name: Column) -> Column:
        return F.array_max(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name))["value"]

    before, after = (F.coalesce(m, F.create_map().cast("map<string,string>")) for m in (old, new))
    here, there = names(before), names(after)

    def change(name: Column) -> Column:
        was, is_ = last(before, name), last(after, name)
        kind = F.when(~F.array_contains(here, name), "added").when(~F.array_contains(there, name), "gone").when(~was.eqNullSafe(is_), "changed")
        return F.struct(name.alias("name"), kind.alias("change"), was.alias("old"), is_.alias("new"))

    return F.filter(F.transform(F.array_sort(F.array_union(here, there)), change), lambda c: c["change"].isNotNull())


def header_drift(answers: DataFrame, by: Sequence[str], order: Sequence[str], headers: str = "headers") -> DataFrame:
    """answers without headers, with a row for each header in which an answer differs from the one before it (of the same by, in order);
    the first answers have none before them."""
    keys = [c for c in answers.columns if c != headers]
    before = Window.partitionBy(*by).orderBy(*order)
    pairs = answers.withColumns({"_before": F.lag(headers).over(before), "_at": F.row_number().over(before)}).where("_at > 1")
    return pairs.select(*keys, F.explode(header_changes(F.col("_before"), F.col(headers))).alias("_c")).select(*keys, "_c.*")


def duplicate_citations(listing: DataFrame) -> DataFrame:
    """(neutral, n) of citations that several entries of a listing have."""
    return listing.where("coalesce(neutral, '') != ''").groupBy("neutral").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def event_faults(lines: DataFrame, known: Sequence[str], line: str = "line") -> DataFrame:
    """(keys of lines, fault) of a log of JSON objects: not_json, unknown_kind, unknown:<column> for columns that no event has, and
    missing:<column> for what its kind needs."""
    keys = [c for c in lines.columns if c != line]
    parsed = F.from_json(line, "map<string,string>")
    rows = lines.select(*keys, parsed.alias("m"), F.when(F.try_parse_json(line).isNotNull() & F.startswith(F.ltrim(line), F.lit("{")), True).otherwise(False).alias("ok"))
    kind = F.try_element_at("m", F.lit("kind"))
    needs = F.coalesce(*(F.when(kind == k, F.array(*map(F.lit, c)) if c else F.array().cast("array<string>")) for k, c in REQUIRED.items()))
    odd = F.transform(F.array_except(F.map_keys("m"), F.array(*map(F.lit, known))), lambda c: F.concat(F.lit("unknown:"), c))
    lacking = F.transform(F.filter(needs, lambda c: F.try_element_at("m", c).isNull()), lambda c: F.concat(F.lit("missing:"), c))
    of_kind = F.when(needs.isNull(), F.array(F.lit("unknown_kind"))).otherwise(lacking)
    return rows.select(*keys, F.explode(F.when(~F.col("ok"), F.array(F.lit("not_json"))).otherwise(F.concat(of_kind, odd))).alias("fault"))
