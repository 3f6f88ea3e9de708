"""Sinks: documents and their sidecars as tables of files, to be published as versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import scalars, text

LANGUAGES = ("en", "zh")


def _when(formats: Column, name: str, content: Column) -> Column:
    return F.when(F.array_contains(formats, name), F.struct(F.lit(name).alias("suffix"), content.alias("content")))


def _exploded(rows: DataFrame, folder: Column, stem: Column, infix: Column, parts: list[Column]) -> DataFrame:
    parted = rows.select(folder.alias("folder"), stem.alias("stem"), infix.alias("infix"), F.explode(F.array_compact(F.array(*parts))).alias("p"))
    return parted.select(F.concat("folder", F.lit("/"), "stem", "infix", F.lit("."), "p.suffix").alias("path"), F.col("p.content").alias("content"))


def judgment_files(judgments: DataFrame, base: str, translation: bool = False) -> DataFrame:
    """(path, content) of judgments (court, year, number, lang, formats, and what ``listings.judgments`` gives): the page, its text and
    its facts as JSON, as formats asks for; translations have .tc before the suffix."""
    facts = F.to_json(F.struct("title", "case_number", F.col("court_name").alias("court"), "date", F.col("neutral").alias("neutral_citation"), F.col("parallel").alias("parallel_citations"), "doc_url", "has_translation", F.concat_ws("/", F.lit(base), "lang", F.lit("cases"), "court", F.col("year").cast("string"), F.col("number").cast("string")).alias("url")), {"ignoreNullFields": "false"})
    parts = [_when(F.col("formats"), "html", F.col("content")), _when(F.col("formats"), "txt", text.html_to_text("content")), _when(F.col("formats"), "json", facts)]
    return _exploded(judgments, F.concat_ws("/", "court", F.col("year").cast("string")), scalars.case_key(F.col("court"), F.col("year"), F.col("number"), "_"), F.lit(".tc" if translation else ""), parts)


def snapshot_files(fetched: DataFrame, folder: str, name: Column) -> DataFrame:
    """(path, content) of raw payloads (body), as they came."""
    return fetched.select(F.concat(F.lit(f"{folder}/"), name, F.lit(".json")).alias("path"), F.col("body").alias("content"))


def statute_files(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, content) of statutes (abbr, num, lang, versions, content), and (abbr, num, lang, formats) of what was written."""
    stem = F.concat_ws("_", "abbr", "num", "lang")
    parts = [F.when(F.col(c).isNotNull(), F.struct(F.lit(f"{c}.json").alias("suffix"), F.col(c).alias("content"))) for c in ("versions", "content")]
    files = _exploded(documents, F.concat_ws("/", F.lit("legis"), "abbr", "num"), stem, F.lit(""), parts)
    formats = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), c) for c in ("versions", "content"))))
    return files, documents.select("abbr", "num", "lang", formats.alias("formats"))


def treaty_files(documents: DataFrame, kind: str = "treaties") -> DataFrame:
    """(path, content, bytes) of treaties and secondary documents (abbr, year, num, lang, metadata, pdf, extracted): the facts as JSON,
    the PDF and what text it gave, where there are any."""
    parts = [F.struct(F.lit("json").alias("suffix"), F.col("metadata").alias("content"), F.lit(None).cast("binary").alias("bytes")),
             F.when(F.col("pdf").isNotNull(), F.struct(F.lit("pdf").alias("suffix"), F.lit(None).cast("string").alias("content"), F.col("pdf").alias("bytes"))),
             F.when(F.coalesce("extracted", F.lit("")) != "", F.struct(F.lit("txt").alias("suffix"), F.col("extracted").alias("content"), F.lit(None).cast("binary").alias("bytes")))]
    stem = F.concat_ws("_", "abbr", F.col("year").cast("string"), F.col("num").cast("string"), "lang")
    rows = documents.select(F.concat_ws("/", F.lit(kind), "abbr", F.col("year").cast("string")).alias("folder"), stem.alias("stem"), F.explode(F.array_compact(F.array(*parts))).alias("p"))
    return rows.select(F.concat("folder", F.lit("/"), "stem", F.lit("."), "p.suffix").alias("path"), "p.content", "p.bytes")


def privy_files(documents: DataFrame) -> DataFrame:
    """(path, content) of privy-council judgments (abbr, year, num, lang, content): Chinese ones have .tc before the suffix."""
    stem = F.concat_ws("_", "abbr", F.col("year").cast("string"), F.col("num").cast("string"))
    parts = [F.struct(F.lit("html").alias("suffix"), F.col("content").alias("content")), F.struct(F.lit("txt").alias("suffix"), text.html_to_text("content").alias("content"))]
    return _exploded(documents, F.concat_ws("/", "abbr", F.col("year").cast("string")), stem, F.when(F.col("lang") == "tc", ".tc").otherwise(""), parts)


def merged_decisions(rows: DataFrame, sources: tuple[str, str]) -> DataFrame:
    """(year, num, lang, metadata): both sources' facts of a decision (structs of these names) as one JSON object."""
    return rows.select("year", "num", "lang", F.to_json(F.struct(*sources), {"ignoreNullFields": "false"}).alias("metadata"))


def enrichment_files(rows: DataFrame) -> DataFrame:
    """(path, content) of press summaries (kind summary, lang en or zh; another raises) and appeal histories (kind history)."""
    good = F.when(F.col("lang").isin(*LANGUAGES), F.col("lang")).otherwise(F.raise_error(F.lit("a press summary is in en or zh")).cast("string"))
    suffix = F.when(F.col("kind") == "summary", F.concat(F.lit(".summary_"), good, F.lit(".html"))).otherwise(".appeal_history.json")
    return rows.select(F.concat_ws("/", "court", F.col("year").cast("string"), F.concat(scalars.case_key(F.col("court"), F.col("year"), F.col("number"), "_"), suffix)).alias("path"), F.col("body").alias("content"))
