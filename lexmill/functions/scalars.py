"""Scalar rules over names, dockets, titles, counts and log lines, as native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prefixes of dockets by court.
COURT_PREFIXES: dict[str, str] = {
    "hkcfi": "HCMP HCA HCB HCPI HCCC HCAJ HCAL HCCT HCCW HCIA HCIP HCMA HCMC HCPD HCPT HCSD HCZZ",
    "hkca": "CACV CACC CAAR CAAG CAAM CAAP CAQL CAMP",
    "hkcfa": "FACC FACV FAMV FAMP",
    "hkdc": "DCCC DCCJ DCCV DCEC DCMP DCPI DCPA DCSA DCTC DCZZ",
}
#: Slugs whose documents are asked for under another name.
WIRE_SLUGS = {"bacpg": "hktba", "bahkg": "hktba", "histlaw": "hkhistlaws"}
#: Names of languages in the anchors of press summaries.
SUMMARY_LANGUAGES = {
    "english": "English", "en": "English", "chinese": "Chinese", "zh": "Chinese", "zh-hant": "Chinese", "zh-hans": "Chinese",
    "traditional chinese": "Chinese", "simplified chinese": "Chinese",
}


def _choose(key: Column, values: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(key == k, F.lit(v)) for k, v in values.items()))


def case_url(url: Column, host: str) -> Column:
    """struct(lang, court, year, number) of a case's address at the host, with or without www; null for any other text."""
    pattern = rf"^https?://(?:www\.)?{host.replace('.', chr(92) + '.')}/(en|tc)/cases/([a-z]+)/(\d{{4}})/(\d+)/?$"
    part = [F.regexp_extract(url, pattern, i) for i in range(1, 5)]
    return F.when(url.rlike(pattern), F.struct(part[0].alias("lang"), part[1].alias("court"), part[2].cast("int").alias("year"), part[3].cast("bigint").alias("number")))


def case_key(court: Column, year: Column, number: Column, sign: str = "/") -> Column:
    """court/year/number, or with sign "_" the stem of the case's files."""
    return F.concat_ws(sign, court, year.cast("string"), number.cast("string"))


def stem_parts(stem: Column) -> Column:
    """struct(court, year, number) of a stem; null if it has another shape."""
    pattern = r"^([a-z]+)_(\d{4})_(\d+)$"
    part = [F.regexp_extract(stem, pattern, i) for i in (1, 2, 3)]
    return F.when(stem.rlike(pattern), F.struct(part[0].alias("court"), part[1].cast("int").alias("year"), part[2].cast("bigint").alias("number")))


def docket_court(docket: Column) -> Column:
    """The court of a docket like "HCMP 12/2020" or "HKCFA5/2024": by its prefix, or the prefix itself if it begins with hk; else null."""
    pattern = r"^([A-Za-z]+)\s*\d+/\d{4}$"
    prefix = F.regexp_extract(docket, pattern, 1)
    of = {p: court for court, prefixes in COURT_PREFIXES.items() for p in prefixes.split()}
    known = F.try_element_at(F.create_map(*(F.lit(x) for pair in of.items() for x in pair)), F.upper(prefix))
    return F.when(docket.rlike(pattern), F.coalesce(known, F.when(F.lower(prefix).startswith("hk"), F.lower(prefix))))


def wire_slug(slug: Column) -> Column:
    return F.coalesce(_choose(slug, WIRE_SLUGS), slug)


def title_number(title: Column, year: Column) -> Column:
    """The number that a title names ("AAB 232-2013", "AAB 5/2020"), if its year is this one; else null."""
    pattern = r"(?i)AAB\s+(\d+)[-_/](\d{4})"
    return F.when(title.rlike(pattern) & (F.regexp_extract(title, pattern, 2).cast("int") == year), F.regexp_extract(title, pattern, 1).cast("int"))


def count_cell(local: Column, live: Column) -> Column:
    """"local / live"; where both are known and differ, bold and with the signed difference; a dash for what is not known."""
    shown = F.concat_ws(" / ", *(F.coalesce(c.cast("string"), F.lit("—")) for c in (local, live)))
    delta = F.format_string("%+d", (live - local).cast("bigint"))
    return F.when(local != live, F.concat(F.lit("**"), shown, F.lit(" ("), delta, F.lit(")**"))).otherwise(shown)


def log_warning(line: Column) -> Column:
    """"[HH:MM:SS] message" of a line "date time,ms LEVEL name: message" of level WARNING, ERROR or CRITICAL; null for others."""
    at = F.instr(line, ": ")
    parts = F.split(F.trim(F.regexp_replace(F.substring(line, F.lit(1), F.greatest(at - 1, F.lit(0))), r"\s+", " ")), " ")
    wanted = (at > 0) & (F.size(parts) >= 3) & F.get(parts, F.lit(2)).isin("WARNING", "ERROR", "CRITICAL")
    return F.when(wanted, F.concat(F.lit("["), F.get(F.split(F.get(parts, F.lit(1)), ","), F.lit(0)), F.lit("] "), F.trim(F.substring(line, at + 2, F.length(line)))))


def preview(body: Column, length: int = 200) -> Column:
    """The beginning of a body on one line."""
    return F.replace(F.substring(body, 1, length), F.lit("\n"), F.lit(" "))


def press_summaries(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages (without html) with a row for each language of a press summary that an anchor names: lang and href; the first wins."""
    keys = [c for c in pages.columns if c != html]
    anchor = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    rows = pages.select(*keys, F.posexplode(F.arrays_zip(F.regexp_extract_all(html, F.lit(anchor), 1).alias("href"), F.regexp_extract_all(html, F.lit(anchor), 2).alias("inner"))).alias("position", "a"))
    text = F.trim(F.regexp_replace(F.regexp_replace("a.inner", "<[^>]*>", " "), r"\s+", " "))
    said = F.trim(F.regexp_extract(text, r"(?i)press\s+summary\s*\(([^)]+)\)", 1))
    lang = F.coalesce(_choose(F.lower(said), SUMMARY_LANGUAGES), said)
    return rows.where(said != "").select(*keys, lang.alias("lang"), "position", F.col("a.href").alias("href")).groupBy(*keys, "lang").agg(F.min_by("href", "position").alias("href"))


def markdown_rows(texts: DataFrame, text: str, columns: list[str], flag: str | None = None) -> DataFrame:
    """Rows of the pipe tables in texts with as many cells as columns, in order (position); headers, separators and other lines go.
    A header is the line before a separator.  A tick in the column flag becomes true, anything else false."""
    keys = [c for c in texts.columns if c != text]
    lines = texts.select(*keys, F.split(text, "\n").alias("_l"))
    at = lines.select(*keys, "_l", F.posexplode("_l").alias("position", "_line"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("_line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    separator = r"^\s*\|?[\s:|-]*-[\s:|-]*$"
    after = F.coalesce(F.get("_l", F.col("position") + 1), F.lit(""))
    rows = at.where(F.trim("_line").startswith("|") & ~F.col("_line").rlike(separator) & ~after.rlike(separator)).withColumn("_c", cells).where(F.size("_c") == len(columns))
    value = lambda i, c: (F.get("_c", F.lit(i)) == "✅") if c == flag else F.get("_c", F.lit(i))
    return rows.select(*keys, "position", *(value(i, c).alias(c) for i, c in enumerate(columns)))
