"""Captured listings and documents (JSON text) to typed rows, natively.

Inputs have a column body with the payload's text and any key columns, which are kept.  Bodies that are null or no JSON objects give
no rows; entries whose path has not the wanted shape go, and where the rule says so they are counted.  position counts all entries
of a body from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns: paths of cases, treaties, secondary documents and privy-council cases.
CASE_PATH = r"/(?:en|tc)/cases/([a-z]+)/(\d{4})/(\d+)"
TREATY_PATH = r"^/(?:en|tc)/legis/[a-z]+/(nd|\d{4})/(\d+)/?"
SECONDARY_PATH = r"^/(?:en|tc|sc)/(?:legis|other)/[a-z]+/(nd|\d{4})/(\d+)/?"
PRIVY_PATH = r"^(?:/(?:en|tc)/cases/[a-z]+)?/(\d{4})/(\d+)/?$"

_CASES = "struct<totalfiles:bigint,judgments:array<struct<path:string,neutral:string,date:string,cases:array<struct<title:string>>>>>"
_FILES = "struct<totalfiles:bigint,files:array<struct<path:string,num:string,title:string,neutral:string,date:string>>>"
_JUDGMENT = "struct<db:string,date:string,neutral:string,parallel_citation:array<string>,content:string,doc:string,has_translation:boolean,cases:array<struct<title:string,act:string>>>"
_DOCUMENT = "struct<title:string,neutral:string,date:string,content:string,pdf:string>"


def page_count(total: Column, size: int) -> Column:
    """How many pages of this size a listing has."""
    return F.ceil(total / size).cast("int")


def pages_read(pages: DataFrame, keys: list[str], page: str = "page", body: str = "body") -> DataFrame:
    """The pages that a reader would ask for: in order, until all files that a page's total names were seen or a page is empty (that
    page is still read)."""
    from pyspark.sql import Window

    parsed = F.from_json(body, _FILES)
    rows = pages.withColumn("_n", F.coalesce(F.size(parsed["files"]), F.lit(0))).withColumn("_total", F.coalesce(parsed["totalfiles"], F.lit(0)))
    before = Window.partitionBy(*keys).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_seen", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_ended", F.coalesce(F.max((F.col("_n") == 0).cast("int")).over(before), F.lit(0)))
    full = F.coalesce(F.max(F.col("_done")).over(before), F.lit(0))
    rows = rows.withColumn("_done", (F.col("_seen") + F.col("_n") >= F.col("_total")).cast("int"))
    return rows.where((F.col("_ended") == 0)).withColumn("_full", full).where("_full = 0").drop("_n", "_total", "_seen", "_ended", "_done", "_full")


def _entries(pages: DataFrame, schema: str, field: str, body: str) -> DataFrame:
    keys = [c for c in pages.columns if c != body]
    parsed = pages.select(*keys, F.from_json(body, schema).alias("_b"))
    return parsed.select(*keys, F.coalesce("_b.totalfiles", F.lit(0).cast("bigint")).alias("total"), F.posexplode(f"_b.{field}").alias("position", "_e"))


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def court_listing(pages: DataFrame, body: str = "body") -> DataFrame:
    """Entries of a court's listing: total, position, year, number, neutral, title (the first case's) and date; missing ones are ''."""
    rows = _entries(pages, _CASES, "judgments", body)
    part = [F.regexp_extract("_e.path", CASE_PATH, i) for i in (2, 3)]
    title = F.coalesce(F.get("_e.cases", F.lit(0))["title"], F.lit(""))
    return rows.where(F.col("_e.path").rlike(CASE_PATH)).select("*", part[0].cast("int").alias("year"), part[1].cast("bigint").alias("number"), _text("_e.neutral").alias("neutral"), title.alias("title"), _text("_e.date").alias("date")).drop("_e")


def statute_listing(pages: DataFrame, body: str = "body") -> DataFrame:
    """Entries of a statute listing: total, position, num (needed) and title."""
    rows = _entries(pages, _FILES, "files", body)
    return rows.where("_e.num is not null").select("*", F.col("_e.num").alias("num"), _text("_e.title").alias("title")).drop("_e")


def treaty_listing(pages: DataFrame, body: str = "body") -> DataFrame:
    """Entries of a treaty listing: total, position, year ('nd' where there is no date), num, title, neutral, date."""
    rows = _entries(pages, _FILES, "files", body).where(F.col("_e.path").rlike(TREATY_PATH))
    return rows.select("*", F.regexp_extract("_e.path", TREATY_PATH, 1).alias("year"), F.regexp_extract("_e.path", TREATY_PATH, 2).cast("int").alias("num"), _text("_e.title").alias("title"), "_e.neutral", "_e.date").drop("_e")


def secondary_listing(pages: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Entries of a secondary listing (year, num, title, neutral, date), and for each page how many were skipped: those of another
    path, and those without a date."""
    rows = _entries(pages, _FILES, "files", body)
    good = F.coalesce(F.col("_e.path").rlike(SECONDARY_PATH) & (F.regexp_extract("_e.path", SECONDARY_PATH, 1) != "nd"), F.lit(False))
    keys = [c for c in pages.columns if c != body]
    found = rows.where(good).select("*", F.regexp_extract("_e.path", SECONDARY_PATH, 1).cast("int").alias("year"), F.regexp_extract("_e.path", SECONDARY_PATH, 2).cast("int").alias("num"), _text("_e.title").alias("title"), "_e.neutral", "_e.date").drop("_e")
    return found, rows.groupBy(*keys).agg(F.count_if(~good).alias("skipped"))


def privy_listing(pages: DataFrame, body: str = "body") -> DataFrame:
    """Entries of a privy-council listing, whose paths come with and without a prefix: year, num, neutral, date, title."""
    rows = _entries(pages, _FILES, "files", body).where(F.col("_e.path").rlike(PRIVY_PATH))
    return rows.select("*", F.regexp_extract("_e.path", PRIVY_PATH, 1).cast("int").alias("year"), F.regexp_extract("_e.path", PRIVY_PATH, 2).cast("int").alias("num"), _text("_e.neutral").alias("neutral"), _text("_e.date").alias("date"), _text("_e.title").alias("title")).drop("_e")


def privy_document(fetched: DataFrame, body: str = "body") -> DataFrame:
    """title, neutral, date, content and error of fetched documents (abbr, year, num, lang): blank content is an error."""
    d = F.from_json(body, _DOCUMENT)
    blank = F.trim(F.coalesce(d["content"], F.lit(""))) == ""
    said = F.concat(F.lit("empty content for "), F.concat_ws("/", "abbr", F.col("year").cast("string"), F.col("num").cast("string"), "lang"))
    return fetched.select(*(c for c in fetched.columns if c != body), *(F.when(~blank, F.coalesce(d[c], F.lit(""))).alias(c) for c in ("title", "neutral", "date", "content")), F.when(blank, said).alias("error"))


def judgments(fetched: DataFrame, body: str = "body") -> DataFrame:
    """title, case_number, court_name, date, neutral, parallel, content, doc_url and has_translation of fetched judgments; the first
    case of each names it."""
    d = F.from_json(body, _JUDGMENT)
    first = F.get(d["cases"], F.lit(0))
    columns = {
        "title": F.coalesce(first["title"], F.lit("")),
        "case_number": F.coalesce(first["act"], F.lit("")),
        "court_name": F.coalesce(d["db"], F.lit("")),
        "date": F.coalesce(d["date"], F.lit("")),
        "neutral": F.coalesce(d["neutral"], F.lit("")),
        "parallel": F.coalesce(d["parallel_citation"], F.array().cast("array<string>")),
        "content": F.coalesce(d["content"], F.lit("")),
        "doc_url": F.nullif(d["doc"], F.lit("")),
        "has_translation": F.coalesce(d["has_translation"], F.lit(False)),
    }
    return fetched.select(*(c for c in fetched.columns if c != body), *(c.alias(n) for n, c in columns.items()))


def list_error(status: Column, body: Column) -> Column:
    """Why a response that must be 200 and a JSON list is none; null if it is one."""
    return F.when(status != 200, F.concat(F.lit("HTTP "), status.cast("string"))).when(~F.coalesce(F.ltrim(body).startswith("[") & F.try_parse_json(body).isNotNull(), F.lit(False)), "not a JSON list")


def related_caps(fetched: DataFrame, body: str = "body") -> DataFrame:
    """(parent_cap, child_cap, lang, title) of fetched lists (cap, abbr, lang): the ordinance itself ('ord') gives none, and entries
    without a number go."""
    rows = fetched.where(F.col("abbr") != "ord").select("cap", "lang", F.explode(F.from_json(body, "array<struct<num:string,title:string>>")).alias("e"))
    return rows.where("coalesce(e.num, '') != ''").select(F.col("cap").alias("parent_cap"), F.col("e.num").alias("child_cap"), "lang", F.coalesce("e.title", F.lit("")).alias("title"))


def statute_documents(versions: DataFrame, tocs: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Both hops of a statute: the first of its versions is the one in force; its table of contents is joined by vid.  No versions
    and no table are errors."""
    listed = F.from_json(body, "array<struct<id:bigint,date:string>>")
    first = versions.select(*keys, F.get(listed, F.lit(0)).alias("v")).select(*keys, F.col("v.id").alias("vid"), F.col("v.date").alias("version_date"))
    out = first.join(tocs.select("vid", "content"), "vid", "left")
    error = F.when(F.col("vid").isNull(), "no versions returned").when(F.col("content").isNull(), "no table of contents")
    return out.select(*keys, "vid", "version_date", "content", error.alias("error"))


def history_targets(documents: DataFrame, versions: DataFrame, sidecars: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """(keys, vid, version_date) still to be fetched: of downloaded documents (latest_vid) every listed version but the latest
    that has no sidecar (keys, vid); entries without a numeric id go."""
    done = documents.where("status = 'downloaded'").select(*keys, "latest_vid")
    listed = versions.select(*keys, F.explode(F.from_json(body, "array<struct<id:string,date:string>>")).alias("e"))
    rows = listed.select(*keys, F.col("e.id").try_cast("bigint").alias("vid"), F.coalesce("e.date", F.lit("")).alias("version_date")).where("vid is not null")
    return rows.join(done, keys).where(~F.col("vid").eqNullSafe(F.col("latest_vid"))).drop("latest_vid").join(sidecars, [*keys, "vid"], "left_anti")


def pdf_documents(metadata: DataFrame, files: DataFrame, base: str, body: str = "body") -> DataFrame:
    """Metadata rows with the PDF that they name (files: url, content): outcome downloaded, html (no PDF named), missing or not_pdf."""
    url = pdf_url(F.from_json(body, _DOCUMENT)["pdf"], base)
    rows = metadata.withColumn("url", url).join(files.select("url", "content"), "url", "left")
    pdf = F.coalesce(F.substring("content", 1, 4) == F.lit("%PDF").cast("binary"), F.lit(False))
    return rows.withColumn("outcome", F.when(F.col("url").isNull(), "html").when(F.col("content").isNull(), "missing").when(pdf, "downloaded").otherwise("not_pdf")).drop(body)


def pdf_with_fallback(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted (file, lang) with content and lane: that of the Chinese lane if tc is wanted and it is there, else the English one's."""
    lane = lambda name: files.where(F.col("lane") == name).select("file", F.col("content").alias(f"_{name}"))
    out = wanted.join(lane("tc"), "file", "left").join(lane("en"), "file", "left")
    first = (F.col("lang") == "tc") & F.col("_tc").isNotNull()
    return out.select(*wanted.columns, F.when(first, F.col("_tc")).otherwise(F.col("_en")).alias("content"), F.when(first, "tc").when(F.col("_en").isNotNull(), "en").alias("lane"))


def probe_outcome(url: Column, status: Column, body: Column) -> tuple[Column, Column]:
    """(live_count, error) of a captured live count; nothing raises."""
    count = F.try_cast(F.get_json_object(body, "$.count"), "bigint") if hasattr(F, "try_cast") else F.get_json_object(body, "$.count").try_cast("bigint")
    error = F.when(url.isNull(), "unmapped_endpoint").when(status != 200, F.concat(F.lit("HTTP "), status.cast("string"))).when(F.try_parse_json(body).isNull(), "bad JSON")
    return F.when(error.isNull(), F.coalesce(count, F.lit(0))), error


def pdf_url(raw: Column, base: str) -> Column:
    """An absolute address as it is, a path joined to the base; null for none."""
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit(None).cast("string")).when(raw.rlike("^https?://"), raw).when(raw.startswith("/"), F.concat(F.lit(base), raw)).otherwise(F.concat(F.lit(f"{base}/"), raw))


def query_url(base: str, endpoint: str, **parts: Column) -> Column:
    """base/api/endpoint?name=value&..., values encoded as in forms (a space is a plus)."""
    pairs = [F.concat(F.lit(f"{'&' if i else ''}{name}="), F.url_encode(value.cast("string"))) for i, (name, value) in enumerate(parts.items())]
    return F.concat(F.lit(f"{base}/api/{endpoint}?"), *pairs)


def probe_url(base: str, category: Column, slug: Column, lang: Column) -> Column:
    """Where the live count of a category's slug is asked for; null for categories without an endpoint."""
    of = {"cases": ("getmetacase", {"caseDb": slug}), "legis": ("getmetalegis", {"cap_type": slug})}
    of |= {c: ("getmetahopt", {"dbcat": F.lit(d), "abbr": slug}) for c, d in (("cases-ukpc", "C"), ("legis-hopt", "other"), ("legis-histlaw", "H"), ("other-O", "O"), ("other-P", "P"))}
    return F.coalesce(*(F.when(category == c, query_url(base, endpoint, **parts, lang=lang)) for c, (endpoint, parts) in of.items()))
