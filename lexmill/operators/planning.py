"""Update plans, guards, outcomes and the freshness report: rules over a few rows on the driver, and over tables in Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from typing import Any
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import payloads, scalars
from lexmill.operators import marks

ZONE = ZoneInfo("Asia/Hong_Kong")
#: The steps in their order, by the switch that asks for each.
STEPS = {
    "freshness_check": "check_freshness", "scrape": "scrape", "recheck_html": "recheck_html", "generate_html": "generate_html", "noteup": "scrape_noteup",
    "enrich": "enrich", "canary": "coverage_canary", "hopt": "scrape_hopt", "d3": "scrape_d3", "ukpc": "scrape_ukpc", "legis": "scrape_legis",
    "legis_history": "backfill_legis_history", "backfill_translations": "backfill_case_translations", "relatedcaps": "scrape_relatedcaps",
    "validate": "validate", "full_reconcile": "full_reconcile", "orphan_mark": "orphan_mark",
}
#: What every profile sets, and what each profile adds to the steps of the one before.
_BASE = {"recent_days": None, "items_per_page": 500, "recheck_max_age_days": None, "generate_html_limit": None, "enrich_retry_limit": 100, "validate_sample": 2000, "canary_divergence_threshold": 5}
_DAILY = frozenset(("freshness_check", "scrape", "recheck_html", "generate_html", "noteup", "enrich", "canary", "backfill_translations"))
_WEEKLY = _DAILY | {"hopt", "ukpc", "legis"}
_MONTHLY = _WEEKLY | {"legis_history", "d3", "validate"}
PROFILES: dict[str, tuple[dict[str, Any], frozenset[str]]] = {
    "daily": ({"recent_days": 30, "recheck_max_age_days": 30}, _DAILY),
    "weekly": ({"recent_days": 30, "recheck_max_age_days": 30}, _WEEKLY),
    "monthly": ({"recent_days": 90, "recheck_max_age_days": 365, "generate_html_limit": 0}, _MONTHLY),
    "quarterly": ({"recheck_max_age_days": 0, "generate_html_limit": 0}, frozenset(STEPS)),
    "custom": ({}, frozenset()),
}


class PlanError(ValueError):
    """A plan that must not run."""


@dataclass(frozen=True)
class Step:
    name: str
    settings: dict[str, Any] = field(default_factory=dict)


@dataclass
class Plan:
    """Settings of a profile with what the caller overrides (None does not), checked."""

    profile: str
    overrides: dict[str, Any] = field(default_factory=dict)
    narrow_allowed: bool = False

    def __post_init__(self) -> None:
        if self.profile not in PROFILES:
            raise PlanError(f"unknown profile {self.profile!r}; choose from {sorted(PROFILES)}")
        own, steps = PROFILES[self.profile]
        self.settings = _BASE | own | {f"include_{s}": s in steps for s in STEPS}
        unknown = set(self.overrides) - set(self.settings)
        if unknown:
            raise PlanError(f"unknown settings {sorted(unknown)}")
        self.settings |= {k: v for k, v in self.overrides.items() if v is not None}
        days = self.settings["recent_days"]
        if days is not None and 0 < days < 2 and not self.narrow_allowed:
            raise PlanError(f"a window of {days} day(s) may miss what other time zones call today; allow it expressly")
        if self.settings["include_orphan_mark"] and not self.settings["include_full_reconcile"]:
            raise PlanError("orphans can only be marked after a full reconciliation in the same run")

    def dates(self, today: date) -> tuple[str | None, str | None]:
        days = self.settings["recent_days"]
        return (None, None) if days is None or days <= 0 else tuple(d.strftime("%d/%m/%Y") for d in (today - timedelta(days=days), today))

    def steps(self, today: date | None = None) -> list[Step]:
        today = today or datetime.now(ZONE).date()
        s, (low, high) = self.settings, self.dates(today)
        of = {
            "scrape": {"recent_days": s["recent_days"], "items_per_page": s["items_per_page"], "min_date": low, "max_date": high, "sort": "-date" if low else None},
            "recheck_html": {"max_age_days": s["recheck_max_age_days"]},
            "generate_html": {"limit": s["generate_html_limit"]},
            "enrich": {"retry_limit": s["enrich_retry_limit"]},
            "canary": {"threshold": s["canary_divergence_threshold"], "most": 3},
            "validate": {"sample": s["validate_sample"]},
            "full_reconcile": {"items_per_page": s["items_per_page"]},
        }
        return [Step(name, {k: v for k, v in of.get(switch, {}).items() if v is not None}) for switch, name in STEPS.items() if s[f"include_{switch}"]]

    def text(self, today: date) -> str:
        rows = [f"  {i:>2}. {s.name}({', '.join(f'{k}={v!r}' for k, v in s.settings.items())})" for i, s in enumerate(self.steps(today), 1)]
        return "\n".join([f"Profile: {self.profile}", f"Today: {today.isoformat()}", "", "Planned steps:", *(rows or ["  (empty)"])])

    def rows(self, spark: SparkSession, today: date) -> DataFrame:
        import json

        return spark.createDataFrame([(i, s.name, json.dumps(s.settings, sort_keys=True)) for i, s in enumerate(self.steps(today), 1)], "place int, step string, settings string")


def dispatch(steps: Iterable[Step], runners: dict[str, Callable[..., Any]]) -> tuple[list[tuple[str, str | None]], int]:
    """Runs each step; an error of one ends that step alone.  (step, error) of each, and how many failed.  A step that nobody runs
    raises before any has begun."""
    steps = list(steps)
    if missing := [s.name for s in steps if s.name not in runners]:
        raise PlanError(f"unknown steps {missing}")
    said: list[tuple[str, str | None]] = []
    for step in steps:
        try:
            runners[step.name](**step.settings)
            said.append((step.name, None))
        except Exception as error:  # one step's failure must not keep the others from running
            said.append((step.name, f"{type(error).__name__}: {error}"))
    return said, sum(error is not None for _, error in said)


def orphan_guard(runs: DataFrame, courts: list[str], langs: list[str], grace: int = 60) -> tuple[int | None, str | None]:
    """(cutoff, None) if the newest completed full run covers all courts and languages, else (None, why not)."""
    run = marks.latest_full_run(runs).first()
    if run is None:
        return None, "no completed full run"
    lacking = [x for x in courts if x not in set(run.courts or [])] + [x for x in langs if x not in set(run.langs or [])]
    return (None, f"run {run.generation} does not cover {lacking}") if lacking else (run.started_at - grace, None)


def canary(local: DataFrame, probes: DataFrame, threshold: int, most: int = 3) -> DataFrame:
    """(court, lang, live, local, diff) of buckets that differ by the threshold or more, the largest first.  Raises if fewer than half
    of the probes (court, lang, live: null where it failed) saw anything."""
    seen = probes.agg(F.count(F.lit(1)).alias("n"), F.count("live").alias("ok")).first()
    if seen.n and seen.ok < seen.n // 2:
        raise PlanError(f"only {seen.ok} of {seen.n} probes saw a count")
    counts = local.where("status = 'downloaded'").groupBy("court", "lang").agg(F.count(F.lit(1)).alias("local"))
    rows = probes.where("live is not null").join(counts, ["court", "lang"], "left").withColumn("local", F.coalesce("local", F.lit(0).cast("bigint")))
    rows = rows.withColumn("diff", F.col("live") - F.col("local")).where(F.abs("diff") >= threshold)
    return rows.orderBy(F.desc(F.abs("diff")), "court", "lang").limit(most).select("court", "lang", "live", "local", "diff")


def fresh_scopes_dropped(scopes: DataFrame, ledger: DataFrame, langs: list[str]) -> DataFrame:
    """Scopes that are still to be listed: all but those that are fresh (ledger: scope, lang, fresh) in every language."""
    fresh = ledger.where(F.col("lang").isin(*langs) & F.col("fresh")).groupBy("scope").agg(F.count_distinct("lang").alias("n")).where(F.col("n") == len(set(langs)))
    return scopes.join(fresh, "scope", "left_anti")


def simulated(freshness: DataFrame, now: int) -> DataFrame:
    """The ledger as it would be if buckets with equal counts had been scraped now: a derived table, so there is nothing to revert."""
    hit = F.coalesce(F.col("live_count") == F.col("local_count"), F.lit(False))
    return freshness.withColumn("last_scrape_completed_at", F.when(hit, F.lit(now).cast("bigint")).otherwise(F.col("last_scrape_completed_at")))


def report(matrix: DataFrame, ledger: DataFrame, langs: tuple[str, ...] = ("en", "tc", "sc")) -> DataFrame:
    """One row for each slug of matrix (slug, langs): for each language its count cell and its date.  Of several kinds cases come before
    legis before hopt; dashes stand for a language that the slug has not and for what is not known."""
    rank = F.when(F.col("kind") == "cases", 0).when(F.col("kind") == "legis", 1).when(F.col("kind") == "hopt", 2)
    cell = F.struct(scalars.count_cell(F.col("local_count"), F.col("live_count")).alias("counts"), F.coalesce("live_updated_at", F.lit("—")).alias("updated"))
    best = ledger.where(rank.isNotNull()).groupBy(F.col("scope").alias("slug"), "lang").agg(F.min_by(cell, rank).alias("cell"))
    wide = best.groupBy("slug").pivot("lang", list(langs)).agg(F.first("cell"))
    out = matrix.join(wide, "slug", "left")
    shown = lambda lang, part: F.when(F.array_contains("langs", lang), F.coalesce(F.col(lang)[part], F.lit("—"))).otherwise("—").alias(f"{lang}_{part}")
    return out.select("slug", *(shown(lang, part) for lang in langs for part in ("counts", "updated")))


def report_markdown(rows: DataFrame, langs: tuple[str, ...] = ("en", "tc", "sc")) -> str:
    """The report as a table in Markdown: a row for each slug."""
    names = ["Slug", *(f"{lang.upper()} {part}" for lang in langs for part in ("local/live", "updated"))]
    lines = ["| " + " | ".join(names) + " |", "| " + " | ".join(["---"] + ["---:", ":---:"] * len(langs)) + " |"]
    lines += ["| " + " | ".join(r) + " |" for r in rows.orderBy("slug").collect()]  # one row for each slug
    return "\n".join(lines)


def download_outcome(fetched: DataFrame) -> DataFrame:
    """outcome, saved and html_later of fetched judgments (content, doc_url, head: the document's first bytes or null, formats).

    A challenge page fails; without content and document the case is empty; a document with unknown first bytes fails, whatever the
    content is; else what was asked for is saved, and a case of a document alone is to be looked at again for its page."""
    from lexmill.functions import text

    content = F.trim(F.coalesce("content", F.lit(""))) != ""
    tried = F.coalesce(F.array_contains("formats", "doc") & F.col("doc_url").isNotNull(), F.lit(False))
    got = tried & F.col("head").isNotNull()
    good = got & text.document_extension(F.col("head")).isNotNull()
    outcome = F.when(payloads.challenge_page(F.col("content")), "challenge").when(~content & ~tried, "empty").when(got & ~good, "doc_invalid_magic").when(~content & ~good, "doc_failed").otherwise("downloaded")
    pages = F.when(content, F.array_remove("formats", "doc")).otherwise(F.array().cast("array<string>"))
    saved = F.when(F.col("outcome") == "downloaded", F.array_sort(F.array_union(pages, F.when(good, F.array(F.lit("doc"))).otherwise(F.array().cast("array<string>")))))
    return fetched.withColumn("outcome", outcome).withColumn("saved", saved).withColumn("html_later", (F.col("outcome") == "downloaded") & ~content)


def recheck_outcome(fetched: DataFrame, formats: tuple[str, ...] = ("html", "json", "txt")) -> DataFrame:
    """outcome and formats of looked-at cases (status, content, old: formats so far): a page that is there is added and the stamp goes;
    a blank one stays pending; a challenge page or another status fails."""
    content = F.trim(F.coalesce("content", F.lit(""))) != ""
    outcome = F.when(F.col("status") != 200, "failed").when(payloads.challenge_page(F.col("content")), "failed").when(content, "newly_captured").otherwise("still_pending")
    new = F.array_sort(F.array_union(F.coalesce("old", F.array().cast("array<string>")), F.array(*map(F.lit, formats))))
    return fetched.withColumn("outcome", outcome).withColumn("formats", F.when(F.col("outcome") == "newly_captured", new).otherwise(F.col("old")))


def summary_outcome(link: Column, body: Column, error: Column) -> tuple[Column, Column]:
    """(state, error) of a press summary: na without a link, failed for an error or a challenge page, else downloaded."""
    challenge = payloads.challenge_page(body)
    state = F.when(link.isNull(), "na").when(error.isNotNull() | challenge, "failed").otherwise("downloaded")
    return state, F.when(link.isNotNull(), F.coalesce(error, F.when(challenge, "challenge page in a press summary")))


def conversion_route(head: Column) -> Column:
    """Which tool makes a page of a document: pandoc for docx and rtf, soffice and then pandoc for older ones, null for others."""
    from lexmill.functions import text

    extension = text.document_extension(head)
    return F.when(extension.isin(".docx", ".rtf"), "pandoc").when(extension == ".doc", "soffice")
