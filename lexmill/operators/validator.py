"""The validator: what a ledger of cases says against an inventory of files, check by check.

cases: court, year, number, status, neutral, formats (array), summary_en_status, summary_zh_status, appeal_history_status,
html_pending (a stamp or null).  files: path ("court/year/name" below the root), size, head (first four bytes), body (text; null
where it is not read) and mtime.  Every check returns rows of one shape (FOUND); joins are by stem, so each file meets at most the
rows of its own case.  Null paths and names without a known shape belong to no case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import payloads, scalars, text

CHECKS = ("presence", "magic", "challenge_html", "stem_coords", "neutral_in_body", "enrichment", "orphans", "html_pending")
#: Rows of cases and files that one task of a join takes, about.
DEALT = 500_000
#: Of a digest, those that a sample's threshold is found by.
DIGITS = 3
FOUND = ("level", "check", "court", "year", "number", "path", "expected", "observed", "detail")
#: Extensions of one family, pages that a firewall may have answered for, and sidecars by kind.
DOC_FAMILY = ("doc", "docx", "rtf")
PAGES = (".html", ".summary_en.html", ".summary_zh.html", ".tc.html")
ENRICHMENT = {"summary_en": ".summary_en.html", "summary_zh": ".summary_zh.html", "appeal_history": ".appeal_history.json"}


def _once(rows: DataFrame, **columns) -> DataFrame:
    """rows with more columns, which are computed once for each row: as a generator makes them, expressions that use them refer to
    them, where a projection would be copied into each filter and each use, and these copies into each other."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def inventory(files: DataFrame) -> DataFrame:
    """files of courts' folders with slug, folder, name, stem and suffix (what follows the stem)."""
    slug, folder, name = (F.split_part("path", F.lit("/"), F.lit(i)) for i in (1, 2, 3))
    rows = _once(files.where(F.col("path").rlike("^hk[a-z]+/[^/]*/[^/]*$")), slug=slug, folder=folder, name=name)
    return _once(rows, stem=payloads.stem(F.col("name")), suffix=payloads.suffix(F.col("name")))


def _keyed(cases: DataFrame) -> DataFrame:
    return cases.where("status = 'downloaded'").withColumn("stem", scalars.case_key(F.col("court"), F.col("year"), F.col("number"), "_"))


def _said(rows: DataFrame, level: str, check: str, **columns) -> DataFrame:
    own = {"level": F.lit(level), "check": F.lit(check), **columns}
    return rows.select(*(own.get(c, F.col(c) if c in rows.columns else F.lit(None)).cast("bigint" if c in ("year", "number") else "string").alias(c) for c in FOUND))


def _in_place(cases: DataFrame, files: DataFrame) -> DataFrame:
    """Files of downloaded cases that lie in their case's folder."""
    rows = _keyed(cases).join(inventory(files).select("stem", "slug", "folder", "suffix", "path", "size", "head", "body", "mtime"), "stem")
    return rows.where((F.col("slug") == F.col("court")) & (F.col("folder") == F.col("year").cast("string")))


def presence(cases: DataFrame, files: DataFrame) -> DataFrame:
    """Formats of downloaded cases without a file that is not empty; any of its family stands for doc."""
    there = _in_place(cases, files).where("size > 0").select("stem", F.substring("suffix", 2, 99).alias("extension"))
    there = there.select("stem", F.when(F.col("extension").isin(*DOC_FAMILY), F.array(F.lit("doc"), "extension")).otherwise(F.array("extension")).alias("f")).select("stem", F.explode("f").alias("format")).distinct()
    wanted = _keyed(cases).select("stem", "court", "year", "number", F.explode("formats").alias("format"))
    rows = wanted.join(there, ["stem", "format"], "left_anti")
    path = F.concat_ws("/", "court", F.col("year").cast("string"), F.concat_ws(".", "stem", "format"))
    return _said(rows, "fatal", "presence", path=path, expected=F.col("format"), detail=F.concat("format", F.lit(" missing or empty")))


def magic(cases: DataFrame, files: DataFrame) -> DataFrame:
    """Documents whose first bytes say another extension, or none."""
    rows = _in_place(cases, files).where(F.col("suffix").isin(*(f".{e}" for e in DOC_FAMILY))).withColumn("real", text.document_extension(F.col("head")))
    rows = rows.where(~F.col("real").eqNullSafe(F.col("suffix")))
    return _said(rows, "fatal", "magic", expected=F.col("suffix"), observed=F.coalesce("real", F.lower(F.hex("head"))), detail=F.when(F.col("real").isNull(), "unknown first bytes").otherwise("first bytes of another extension"))


def challenge_html(cases: DataFrame, files: DataFrame) -> DataFrame:
    rows = _in_place(cases, files).where(F.col("suffix").isin(*PAGES) & payloads.challenge_page(F.col("body")))
    return _said(rows, "fatal", "challenge_html", detail=F.lit("holds a marker of a challenge page"))


def neutral_in_body(cases: DataFrame, files: DataFrame) -> DataFrame:
    """Cases whose text (else page) does not hold their citation, both folded."""
    rows = _in_place(cases, files).where(F.col("suffix").isin(".txt", ".html") & (F.coalesce("neutral", F.lit("")) != ""))
    # ".txt" sorts after ".html"; a case has at most one of each.
    body = rows.groupBy("court", "year", "number", "neutral").agg(F.max_by(F.struct("path", F.coalesce("body", F.lit("")).alias("body")), "suffix").alias("b"))
    folded = body.select("court", "year", "number", F.col("b.path").alias("path"), text.citation_fold("neutral").alias("expected"), text.citation_fold("b.body").alias("folded"))
    return _said(folded.where("expected != '' and not contains(folded, expected)"), "warn", "neutral_in_body", detail=F.lit("the body lacks the citation"))


def enrichment(cases: DataFrame, files: DataFrame) -> DataFrame:
    """Sidecars that a status promises and that are missing, and those that are there in spite of it."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(s).alias("suffix"), F.col(f"{k}_status").alias("state")) for k, s in ENRICHMENT.items()))
    wanted = _keyed(cases).select("stem", "court", "year", "number", F.explode(kinds).alias("k")).select("stem", "court", "year", "number", "k.*")
    there = _in_place(cases, files).select("stem", "suffix", F.lit(True).alias("there"))
    rows = wanted.join(there, ["stem", "suffix"], "left").withColumns({"there": F.coalesce("there", F.lit(False)), "done": F.coalesce(F.col("state") == "downloaded", F.lit(False))}).where("there != done")
    path = F.concat_ws("/", "court", F.col("year").cast("string"), F.concat("stem", "suffix"))
    said = lambda yes: F.when(yes, "present")
    return _said(rows, "fatal", "enrichment", path=path, expected=said(F.col("done")).otherwise("absent"), observed=said(F.col("there")).otherwise("missing"), detail=F.concat("kind", F.when(F.col("done"), ": sidecar missing").otherwise(": sidecar in spite of the status")))


def stem_coords(cases: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose name says another court or year than their folder."""
    rows = _once(inventory(files), p=scalars.stem_parts(F.col("stem"))).where("p is not null and (slug != p.court or folder != cast(p.year as string))")
    return _said(rows, "fatal", "stem_coords", court=F.col("p.court"), year=F.col("p.year"), number=F.col("p.number"), expected=F.concat_ws("/", "p.court", F.col("p.year").cast("string"), F.lit("")), observed=F.concat_ws("/", "slug", "folder", F.lit("")), detail=F.lit("name and folder differ"))


def orphans(cases: DataFrame, files: DataFrame) -> DataFrame:
    """Files that belong to no case of any status.

    Both sides are dealt out by the stem over as many tasks as their rows need, so a task's memory does not grow with the input; files
    without a stem, which meet no case, are dealt out by their path.  No file's stem holds a slash."""
    parts = 1 + (cases.count() + files.count()) // DEALT
    stems = cases.select(scalars.case_key(F.col("court"), F.col("year"), F.col("number"), "_").alias("_by")).where(~F.contains("_by", F.lit("/"))).repartition(parts, "_by")
    named = _once(inventory(files).select("path", "stem"), _by=F.coalesce("stem", F.concat(F.lit("/"), "path"))).repartition(parts, "_by")
    return _said(named.join(stems, "_by", "left_anti"), "warn", "orphans", court=F.lit(None), year=F.lit(None), number=F.lit(None), detail=F.concat(F.lit("no case for stem "), F.coalesce("stem", F.lit("(none)"))))


_RUN = {"presence": presence, "magic": magic, "challenge_html": challenge_html, "neutral_in_body": neutral_in_body, "enrichment": enrichment, "stem_coords": stem_coords, "orphans": orphans}


def validate(cases: DataFrame, files: DataFrame, checks: tuple[str, ...] = CHECKS, sample: int | None = None, seed: int = 0) -> DataFrame:
    """What all checks find (FOUND).  html_pending only counts (see ``summary``) and finds nothing."""
    unknown = set(checks) - set(CHECKS)
    if unknown:
        raise ValueError(f"unknown checks {sorted(unknown)}")
    rows = cases if sample is None else sampled(cases, sample, seed)
    # Orphans are told by all cases, whatever the sample.
    found = [_RUN[c](cases if c == "orphans" else rows, files) for c in checks if c in _RUN]
    return reduce(DataFrame.unionByName, found) if found else _said(cases.limit(0), "info", "none")


def sampled(rows: DataFrame, n: int, seed: int, keys: tuple[str, ...] = ("court", "year", "number")) -> DataFrame:
    """The n rows (of a ledger: downloaded ones) with the least seeded digests of their keys, in no order; 0 means all.  A fixed seed
    gives a fixed sample.

    Digests are counted by their first DIGITS digits.  Rows below the group where the n-th falls are taken as they are read, and only
    that group, a small share of the table, is put in order."""
    done = rows.where("status = 'downloaded'") if "status" in rows.columns else rows
    if not n:
        return done
    drawn = done.withColumn("_drawn", F.md5(F.concat_ws("/", F.lit(seed), *keys))).withColumn("_group", F.substring("_drawn", 1, DIGITS))
    before = 0
    for r in drawn.groupBy("_group").count().orderBy("_group").collect():  # 16 ** DIGITS rows at most
        if before + r["count"] >= n:
            edge = drawn.where(F.col("_group") == r["_group"]).orderBy("_drawn", *keys).limit(n - before)
            return drawn.where(F.col("_group") < r["_group"]).unionByName(edge).drop("_drawn", "_group")
        before += r["count"]
    return done


def by_level(found: DataFrame) -> DataFrame:
    """(level, n): zero where nothing was found."""
    levels = found.sparkSession.createDataFrame([("fatal",), ("warn",), ("info",)], "level string")
    return levels.join(found.groupBy("level").agg(F.count(F.lit(1)).alias("k")), "level", "left").select("level", F.coalesce("k", F.lit(0)).alias("n"))


def fixes(found: DataFrame, files: DataFrame, run_start) -> DataFrame:
    """The plan of repairs: (action, kind, court, year, number, path), to be looked at before anything is done.

    A missing format puts its case back to pending.  A bad document or page is deleted, and its case, or if it is a summary that
    summary alone, goes back to pending.  An orphan older than the run is deleted.  Other findings need a person."""
    bad = found.where(F.col("check").isin("magic", "challenge_html"))
    kind = F.when(F.col("path").endswith(".summary_en.html"), "summary_en").when(F.col("path").endswith(".summary_zh.html"), "summary_zh")
    old = files.where(F.col("mtime") < F.lit(run_start)).select("path")
    plan = [
        (found.where("check = 'presence'"), "reset_case", F.lit(None).cast("string")),
        (bad, "delete_file", F.lit(None).cast("string")),
        (bad.where(kind.isNull()), "reset_case", F.lit(None).cast("string")),
        (bad.where(kind.isNotNull()), "reset_enrichment", kind),
        (found.where("check = 'orphans'").join(old, "path", "left_semi"), "delete_file", F.lit(None).cast("string")),
    ]
    rows = [d.select(F.lit(a).alias("action"), k.alias("kind"), "court", "year", "number", F.when(F.lit(a) == "delete_file", F.col("path")).alias("path")) for d, a, k in plan]
    return reduce(DataFrame.unionByName, rows).distinct()


def exit_code(levels: dict[str, int] | None) -> int:
    """0: nothing found; 1: warnings; 2: fatal findings; 3: there was no ledger to look at."""
    if levels is None:
        return 3
    return 2 if levels.get("fatal") else 1 if levels.get("warn") else 0


def shown(found: DataFrame, most: int = 20) -> DataFrame:
    """The lines of a report: at most so many of each check in order, and then how many more there are."""
    each = Window.partitionBy("check").orderBy("court", "year", "number", "path", "detail")
    where = F.concat_ws("/", "court", F.col("year").cast("string"), F.col("number").cast("string"))
    line = F.concat(F.when(F.col("court").isNotNull(), F.concat(where, F.lit(" "))).otherwise(""), "detail", F.when(F.coalesce("path", F.lit("")) != "", F.concat(F.lit(" ("), F.col("path"), F.lit(")"))).otherwise(""))
    lines = found.withColumn("place", F.row_number().over(each)).where(F.col("place") <= most).select("check", "place", line.alias("line"))
    more = found.groupBy("check").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return lines.unionByName(more.select("check", F.lit(most + 1).alias("place"), F.format_string("... %d more", F.col("n") - most).alias("line")))


def render(found: DataFrame, root: str, pending: int | None = None, most: int = 20) -> str:
    """The report as text: a section for each check that found something, in the order of CHECKS, and the totals."""
    rows = shown(found, most).collect()  # at most 21 lines for each check
    totals = {r.check: (r.level, r.n) for r in found.groupBy("check").agg(F.first("level").alias("level"), F.count(F.lit(1)).alias("n")).collect()}
    lines = [f"Validated {root}", ""]
    for check in CHECKS:
        if check in totals:
            lines += [f"=== {check} [{totals[check][0]}] : {totals[check][1]} ==="]
            lines += [f"  {r.line}" for r in sorted((r for r in rows if r.check == check), key=lambda r: r.place)] + [""]
    levels = {r.level: r.n for r in by_level(found).collect()}
    lines += ["=== summary ===", *(f"  {k}: {levels[k]}" for k in ("fatal", "warn", "info"))]
    return "\n".join(lines if pending is None else [*lines, f"  pages pending: {pending}"])
