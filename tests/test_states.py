"""What the oracles can't say: errors that must be raised, texts of reports, and edges of the libraries."""

import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lexmill.functions import listings, numbers, payloads, scalars, text
from lexmill.operators import marks, monitor, planning, stats, validator
from lexmill.plans import states
from lexmill.session import written
from lexmill.sources import sinks, versions

FOLDER = "/root/testdata/sf0.001"


def test_number_lists(spark):
    said = ["AAB 3-1/2024", "AAB 7 8/2020", "AAB 7-8-9/2020", "aab 4 & 6-7-2019", "AAB 2-2018 & AAB 5-2017 (both)", "AAB 1-2500/2001", None, "nothing"]
    rows = numbers.number_pairs(spark.createDataFrame([(s,) for s in said], "s string"), F.col("s")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.s, []).append((r.year, r.num))
    assert set(by) == {said[3], said[4], said[5]}
    assert sorted(by[said[3]]) == [(2019, 4), (2019, 6), (2019, 7)] and sorted(by[said[4]]) == [(2017, 5), (2018, 2)]
    assert sorted(by[said[5]]) == [(2001, n) for n in range(1, 2501)]


def test_folds_and_lines():
    assert text.folded(" [2001]  X") == "[2001] x" and text.folded("[2001] Ｘ Y") == "x y"
    assert text.plain_text("<p>a\x0bb</p>") == "a\nb" and text.plain_text(None) is None


def test_plans_refuse_what_must_not_run():
    for profile, overrides in (("hourly", {}), ("daily", {"recent_days": 1}), ("daily", {"include_orphan_mark": True}), ("daily", {"speed": 3})):
        with pytest.raises(planning.PlanError):
            planning.Plan(profile, overrides)
    assert planning.Plan("daily", {"recent_days": 1}, narrow_allowed=True).dates(date(2026, 1, 1)) == ("31/12/2025", "01/01/2026")
    assert planning.Plan("custom").steps(date(2026, 1, 1)) == [] and "(empty)" in planning.Plan("custom").text(date(2026, 1, 1))
    assert [s.name for s in planning.Plan("quarterly").steps(date(2026, 1, 1))][-2:] == ["full_reconcile", "orphan_mark"]
    assert planning.Plan("daily", {"recent_days": None}).settings["recent_days"] == 30


def test_dispatch_goes_on_after_an_error():
    def fail(**_):
        raise OSError("gone")

    steps = [planning.Step("a"), planning.Step("b", {"n": 1})]
    assert planning.dispatch(steps, {"a": fail, "b": lambda n: n}) == ([("a", "OSError: gone"), ("b", None)], 1)
    with pytest.raises(planning.PlanError):
        planning.dispatch(steps, {"a": fail})


def test_canary_is_not_blind(spark):
    local = spark.createDataFrame([("hkca", "en", "downloaded")], "court string, lang string, status string")
    probes = spark.createDataFrame([("hkca", "en", 9), ("x", "en", None), ("y", "en", None), ("z", "en", None)], "court string, lang string, live bigint")
    with pytest.raises(planning.PlanError):
        planning.canary(local, probes, 1)
    assert planning.canary(local, probes.limit(2), 1).collect()[0].diff == 8


def test_marks_refuse_unknown_states(spark):
    cases = states._ledger(spark, FOLDER)
    with pytest.raises(ValueError):
        marks.mark_enrichment(cases, cases, "summary_fr")
    bad = cases.limit(1).select("court", "year", "number", F.lit("odd").alias("state"), F.lit(None).cast("string").alias("error"))
    with pytest.raises(Exception, match="unknown state"):
        marks.mark_enrichment(cases, bad, "summary_en").collect()


def test_validator_report_and_fixes(spark):
    cases, files = written(states._ledger(spark, FOLDER), "cases"), written(states._files(spark, FOLDER), "files")
    found = written(validator.validate(cases, files), "found")
    said = validator.render(found, "root", 3, most=2)
    assert "=== presence [fatal]" in said and "more" in said and said.endswith("pages pending: 3")
    levels = {r.level: r.n for r in validator.by_level(found).collect()}
    assert validator.exit_code(levels) == 2 and validator.exit_code({"warn": 1}) == 1 and validator.exit_code({}) == 0 and validator.exit_code(None) == 3
    fixed = written(marks.apply_fixes(cases, written(validator.fixes(found, files, 10**9), "plan")), "fixed")
    assert fixed.count() == cases.count() and validator.validate(fixed, files, ("presence", "magic")).count() == 0
    assert sorted(validator.sampled(cases, 5, 1).collect()) == sorted(validator.sampled(cases.repartition(3), 5, 1).collect()) and validator.sampled(cases, 5, 1).count() == 5
    assert validator.validate(cases.limit(0), files.limit(0)).count() == 0
    with pytest.raises(ValueError):
        validator.validate(cases, files, ("smell",))


def test_seeded_sample_is_whole(spark):
    cases = states._ledger(spark, FOLDER)
    assert states.QUERIES["seeded_sample"](spark, FOLDER).count() == cases.where("status = 'downloaded'").count() > 100
    assert "LIMIT" not in states.ORACLE_SQL["seeded_sample"]


def test_stems_by_their_ends_as_by_the_pattern(spark):
    ends = [*payloads.SIDECARS, *(f".{x}" for x in payloads.JUDGMENTS), ".pdf", ""]
    names = [a + m + b + z for a in ("", "x", "a\nb", "é.") for m in ("", ".tc") for b in ends for z in ("", "\n", "\u0085", " ")] + [None]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("*", payloads.stem(F.col("n")).alias("stem"), payloads.suffix(F.col("n")).alias("suffix"))
    for r in rows.collect():
        found = r.n is not None and re.search(payloads._NAME, r.n.replace("\u0085", "\n").removesuffix("\n"))
        assert (r.stem, r.suffix) == ((found[1], found[2]) if found else (None, None))


def test_files_are_named_once(spark):
    # The names' expressions were copied into each other: 572,691 characters.
    check = validator.stem_coords(states._ledger(spark, FOLDER), states._files(spark, FOLDER))
    assert len(check._jdf.queryExecution().optimizedPlan().toString()) < 100_000


def test_orphans_are_dealt_out_by_rows(spark, monkeypatch):
    cases = spark.createDataFrame([("hkca", 2000, n) for n in range(50)] + [("hk/x", 2000, 1)], "court string, year int, number bigint")
    files = spark.createDataFrame([(f"hkca/2000/{n}",) for n in ("hkca_2000_1.html", "hkca_2000_99.html", *(f"odd{i}" for i in range(50)))] + [(None,), ("hkca/2000/a/b.html",)], "path string")
    monkeypatch.setattr(validator, "DEALT", 10)
    found = validator.orphans(cases, files)
    assert {r.path for r in found.collect()} == {"hkca/2000/hkca_2000_99.html", *(f"hkca/2000/odd{i}" for i in range(50))}
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_findings_are_made_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(states, "written", lambda df, name: made.append(name) or written(df, name))
    for name in ("validator_lines", "validator_fixes"):
        states.QUERIES[name](spark, FOLDER)
    assert made == ["found", "found"]


def test_monitor_report(spark):
    level, said = monitor.render(states._ledger(spark, FOLDER), states._log(spark, FOLDER), None, datetime(2024, 1, 20), 1, minutes=60 * 24 * 60)
    assert said.startswith(f"[{level}]") and "(no log)" in said and monitor.exit_code(level) == monitor.LEVELS.index(level)
    quiet = monitor.alerts(monitor.progress(states._ledger(spark, FOLDER).limit(0), 10, 1), monitor.error_prefixes(states._ledger(spark, FOLDER).limit(0)), None, None)
    assert monitor.severity(quiet) == "HEALTHY"


def test_published_tables_replace_each_other(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    for n in (3, 5):
        versions.publish(spark.range(n).withColumn("part", F.col("id") % 2), path, by=["part"])
        assert versions.current(spark, path).count() == n
    with pytest.raises(Exception, match="en or zh"):
        sinks.enrichment_files(spark.createDataFrame([("hkca", 2000, 1, "fr", "summary", "b")], "court string, year int, number bigint, lang string, kind string, body string")).collect()


def test_payloads_that_are_none(spark):
    rows = spark.createDataFrame([(1, None), (2, "no json"), (3, "[]"), (4, "{}")], "k int, body string")
    for parse in (listings.court_listing, listings.statute_listing, listings.treaty_listing, listings.privy_listing):
        assert parse(rows).count() == 0
    assert listings.judgments(rows).where("k = 4").first().title == ""
    urls = [None, "https://example.org/en/cases/hkca/2001/5", "https://example.com/en/cases/hkca/2001/5", "https://example.org/en/cases/hkca/2001/"]
    got = [r.c for r in spark.createDataFrame([(u,) for u in urls], "u string").select(scalars.case_url(F.col("u"), "example.org").alias("c")).collect()]
    assert [c and c.number for c in got] == [None, 5, None, None]
    assert stats.scoped(rows, "k", []).count() == 0 and stats.scoped(rows, "k", None).count() == 4
