"""State transitions of the ledger as pure functions: the table before, and what happened, give the table after.

Each works on the whole table with at most one join by the table's keys; outcomes hold one row for each key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("court", "year", "number")
KINDS = ("summary_en", "summary_zh", "appeal_history")
STATUSES = ("pending", "downloaded", "na", "failed")


def _outcome(state: DataFrame, outcomes: DataFrame, keys: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """state with the columns of rules replaced where an outcome (aliased new) has the row's keys."""
    joined = state.alias("old").join(outcomes.withColumn("_hit", F.lit(True)).alias("new"), [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys], "left")
    hit = F.col("new._hit").isNotNull()
    return joined.select(*((F.when(hit, rules[c]).otherwise(F.col(f"old.{c}")) if c in rules else F.col(f"old.{c}")).alias(c) for c in state.columns))


def mark_downloaded(cases: DataFrame, outcomes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Outcomes (keys, formats, html_pending): done, with their formats; the stamp is set or cleared; a case keeps its last error."""
    return _outcome(cases, outcomes, keys, {"status": F.lit("downloaded"), "formats": F.col("new.formats"), "html_pending": F.col("new.html_pending")})


def mark_ok(rows: DataFrame, outcomes: DataFrame, keys: Sequence[str], status: str = "ok") -> DataFrame:
    """Fetch tables and documents: done, and the error is cleared."""
    return _outcome(rows, outcomes, keys, {"status": F.lit(status), "error": F.lit(None).cast("string")})


def mark_failed(rows: DataFrame, outcomes: DataFrame, keys: Sequence[str] = KEYS, status: str = "failed") -> DataFrame:
    """Outcomes (keys, error)."""
    return _outcome(rows, outcomes, keys, {"status": F.lit(status), "error": F.col("new.error")})


def mark_enrichment(cases: DataFrame, outcomes: DataFrame, kind: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Outcomes (keys, state, error) of one kind; the error is overwritten, by null too.  States that don't exist raise."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    state = F.when(F.col("new.state").isin(*STATUSES), F.col("new.state")).otherwise(F.raise_error(F.concat(F.lit("unknown state "), F.coalesce("new.state", F.lit("null")))).cast("string"))
    return _outcome(cases, outcomes, keys, {f"{kind}_status": state, f"{kind}_error": F.col("new.error")})


def mark_generated(cases: DataFrame, outcomes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Outcomes (keys, source, error) of converting documents: success has a source and clears the error, failure clears the source."""
    return _outcome(cases, outcomes, keys, {"html_from": F.col("new.source"), "html_error": F.when(F.col("new.source").isNull(), F.col("new.error"))})


def bump_stamp(cases: DataFrame, outcomes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Only the stamp of pages that are still not there."""
    return _outcome(cases, outcomes, keys, {"html_pending": F.col("new.html_pending")})


def release(rows: DataFrame, scope: str | None = None, values: Sequence[str] | None = None) -> DataFrame:
    """in_progress back to pending; with a scope only its values, and an empty list of them changes nothing."""
    hit = F.col("status") == "in_progress"
    if scope is not None:
        hit = hit & F.col(scope).isin(*(values or ()))
    return rows.withColumn("status", F.when(hit, "pending").otherwise(F.col("status")))


def reset_failed(rows: DataFrame, scope: str | None = None, values: Sequence[str] | None = None) -> DataFrame:
    """failed back to pending without its error."""
    hit = F.col("status") == "failed"
    if scope is not None:
        hit = hit & F.col(scope).isin(*(values or ()))
    return rows.withColumns({"status": F.when(hit, "pending").otherwise(F.col("status")), "error": F.when(~hit | hit.isNull(), F.col("error"))})


def reset_enrichment(cases: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """Failed enrichment of these kinds back to pending without its error."""
    hit = {k: F.coalesce(F.col(f"{k}_status") == "failed", F.lit(False)) for k in kinds}
    return cases.withColumns({f"{k}_status": F.when(h, "pending").otherwise(F.col(f"{k}_status")) for k, h in hit.items()} | {f"{k}_error": F.when(~h, F.col(f"{k}_error")) for k, h in hit.items()})


def mark_orphaned(cases: DataFrame, cutoff: int) -> DataFrame:
    """Downloaded cases that no run has seen since the cutoff."""
    gone = (F.col("status") == "downloaded") & (F.col("last_seen").isNull() | (F.col("last_seen") < cutoff))
    return cases.withColumn("status", F.when(gone, "orphaned").otherwise(F.col("status")))


def lacking(cases: DataFrame, files: DataFrame) -> DataFrame:
    """The keys of downloaded cases with a format that has no file."""
    from lexmill.operators import validator

    return validator.presence(cases, files).select(*KEYS).distinct()


def verify(cases: DataFrame, files: DataFrame) -> DataFrame:
    """Downloaded cases with a format that has no file (see ``lacking``) go back to pending without formats."""
    return _outcome(cases, lacking(cases, files), KEYS, {"status": F.lit("pending"), "formats": F.lit(None).cast("array<string>")})


def apply_fixes(cases: DataFrame, plan: DataFrame) -> DataFrame:
    """The row updates of a validator's plan (``validator.fixes``); files are deleted by whoever holds them."""
    cases = _outcome(cases, plan.where("action = 'reset_case'").select(*KEYS).distinct(), KEYS, {"status": F.lit("pending"), "formats": F.lit(None).cast("array<string>"), **({"error": F.lit(None).cast("string")} if "error" in cases.columns else {})})
    for kind in ("summary_en", "summary_zh"):
        rules = {f"{kind}_status": F.lit("pending"), f"{kind}_error": F.lit(None).cast("string")}
        hit = plan.where((F.col("action") == "reset_enrichment") & (F.col("kind") == kind)).select(*KEYS).distinct()
        cases = _outcome(cases, hit, KEYS, {c: r for c, r in rules.items() if c in cases.columns})
    return cases


def start_run(runs: DataFrame, started_at: int, courts: Sequence[str], langs: Sequence[str], min_date: str | None = None, max_date: str | None = None) -> tuple[DataFrame, int]:
    """runs with one more, not completed, and its generation."""
    generation = (runs.agg(F.max("generation").alias("g")).first().g or 0) + 1
    row = runs.sparkSession.createDataFrame([(generation, started_at, None, list(courts), list(langs), min_date, max_date)], "generation bigint, started_at bigint, completed_at bigint, courts array<string>, langs array<string>, min_date string, max_date string")
    return runs.unionByName(row.select(*runs.columns)), generation


def complete_run(runs: DataFrame, generation: int, completed_at: int, buckets: int) -> DataFrame:
    """The run's completion, only if some bucket ran."""
    hit = (F.col("generation") == generation) & F.lit(buckets > 0)
    return runs.withColumn("completed_at", F.when(hit, F.lit(completed_at).cast("bigint")).otherwise(F.col("completed_at")))


def latest_full_run(runs: DataFrame) -> DataFrame:
    """The newest completed run over the whole corpus (no window): one row or none."""
    return runs.where("completed_at is not null and min_date is null and max_date is null").orderBy(F.desc("generation")).limit(1)


def with_windows(runs: DataFrame) -> DataFrame:
    """runs of a ledger that knew no windows: the columns are added, and as no old run can be told to be full, none counts as
    completed.  Runs that have the columns stay as they are."""
    if {"min_date", "max_date"} <= set(runs.columns):
        return runs
    return runs.withColumns({"min_date": F.lit(None).cast("string"), "max_date": F.lit(None).cast("string"), "completed_at": F.lit(None).cast("bigint")})


def freshness_probe(state: DataFrame, probes: DataFrame, keys: Sequence[str] = ("kind", "scope", "lang")) -> DataFrame:
    """What a probe owns: counts and dates stay where it has none, its time and error are overwritten; new keys are inserted."""
    own = {"live_count", "live_updated_at"}
    return _merged(state, probes, keys, own, {"live_probed_at", "probe_error"})


def freshness_local(state: DataFrame, counts: DataFrame, keys: Sequence[str] = ("kind", "scope", "lang")) -> DataFrame:
    return _merged(state, counts, keys, set(), {"local_count", "local_count_at"})


def freshness_scraped(state: DataFrame, marks: DataFrame, keys: Sequence[str] = ("kind", "scope", "lang")) -> DataFrame:
    """When a bucket was scraped and by which generation, which is overwritten even by none."""
    return _merged(state, marks, keys, set(), {"last_scrape_completed_at", "generation"})


def _merged(state: DataFrame, delta: DataFrame, keys: Sequence[str], filled: set[str], overwritten: set[str]) -> DataFrame:
    joined = state.alias("old").join(delta.withColumn("_hit", F.lit(True)).alias("new"), [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys], "full_outer")
    hit = F.col("new._hit").isNotNull()

    def column(c: str) -> Column:
        if c in keys:
            return F.coalesce(f"old.{c}", f"new.{c}")
        if c in filled:
            return F.coalesce(f"new.{c}", f"old.{c}")
        return F.when(hit, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) if c in overwritten else F.col(f"old.{c}")

    return joined.select(*(column(c).alias(c) for c in state.columns))
