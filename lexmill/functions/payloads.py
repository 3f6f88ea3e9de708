"""Captured JSON and HTML payloads to rows, natively."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that only interstitial pages hold.
CHALLENGE_MARKERS = (
    "just a moment...", "cf-challenge", "cloudflare.com", "cloudflare ray", "please enable javascript", "verify you are human",
    "請稍候", "驗證您是人類", "請啟用 JavaScript", "訪問受限", "系統維護", "拒絕存取",
)

#: What file names of the corpus end in, longest first, and the extensions of judgments.
SIDECARS = (".summary_en.html", ".summary_zh.html", ".appeal_history.json", ".generated.html", ".tc.html", ".tc.txt", ".tc.json")
JUDGMENTS = ("html", "txt", "json", "doc", "docx", "rtf")

#: The shortest beginning that leaves a sidecar's suffix, or one of at least a character that leaves a judgment's.
_NAME = "^(.*?)(" + "|".join(x.replace(".", "\\.") for x in SIDECARS) + "|(?<=.)\\.(?:" + "|".join(JUDGMENTS) + "))$"

#: Where a name is broken into lines, the pattern decides; all others are told by their ends, which costs a fraction of it.
_BREAKS = "\n\r\u0085\u2028\u2029"

#: A fixed pattern: the path of a case.
_CASE_PATH = r"^/(en|tc)/cases/([a-z]+)/([0-9]{4})/([0-9]+)/?"
_NOTEUP = "array<struct<path:string,citation_frequency:int,parallel:array<string>>>"


def challenge_page(html: Column) -> Column:
    """Whether any marker occurs, both in lower case; null and empty pages are none."""
    page = F.lower(html)
    return F.coalesce(F.exists(F.array(*map(F.lit, CHALLENGE_MARKERS)), lambda m: F.contains(page, F.lower(m))), F.lit(False))


def anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with a row for each anchor, in order: position from 0 and href; pages without any go."""
    return pages.select("*", F.posexplode(F.regexp_extract_all(html, F.lit(r'<a\s[^>]*?href="([^"]*)"'), 1)).alias("position", "href"))


def _broken(name: Column) -> Column:
    return reduce(Column.__or__, (F.contains(name, F.lit(x)) for x in _BREAKS))


def suffix(name: Column) -> Column:
    """What follows the stem, with its dot; null if there is no stem."""
    ends = [F.when(name.endswith(x), x) for x in SIDECARS] + [F.when(name.endswith(f".{x}") & (F.length(name) > len(x) + 1), f".{x}") for x in JUDGMENTS]
    return F.when(_broken(name), F.nullif(F.regexp_extract(name, _NAME, 2), F.lit(""))).otherwise(F.coalesce(*ends))


def stem(name: Column) -> Column:
    """A file name without its sidecar suffix or judgment extension; null if it has neither."""
    lines = F.when(name.rlike(_NAME), F.regexp_extract(name, _NAME, 1))
    return F.when(_broken(name), lines).otherwise(F.substring(name, F.lit(1), F.length(name) - F.length(suffix(name))))


def noteup_edges(payloads: DataFrame, target: str, body: str) -> DataFrame:
    """(from_key, to_key, citer_lang, citer_freq, position, parallel) of JSON arrays of citing cases; position counts every
    entry of the array, and entries whose path is no case's go. Bodies that are no arrays give no rows."""
    entry = payloads.where(F.ltrim(F.col(body)).startswith("[")).select(F.col(target).alias("to_key"), F.posexplode(F.from_json(body, _NOTEUP)).alias("position", "e"))
    part = [F.regexp_extract("e.path", _CASE_PATH, i) for i in range(1, 5)]
    key = F.concat_ws("/", part[1], part[2].cast("bigint"), part[3].cast("bigint"))
    return entry.where(F.col("e.path").rlike(_CASE_PATH)).select(key.alias("from_key"), "to_key", part[0].alias("citer_lang"), F.col("e.citation_frequency").alias("citer_freq"), "position", F.filter("e.parallel", lambda p: p != "").alias("parallel"))


def holds(documents: DataFrame, needles: DataFrame, broadcast_chars: int = 4_000_000, short_chars: int = 100_000) -> DataFrame:
    """(doc_id, item_id) of all documents whose text holds a needle's text.

    The words within a needle, all but its first and last, stand as whole words wherever it occurs; so texts meet needles by
    hash on three of those, and only what meets is compared in full.  Needles are broadcast if they have at most so many
    characters together, and else dealt out.  Needles of under five words have no such three and are compared with every text,
    in slices of about short_chars characters.  Rows equal in id and text count once.
    """
    words = F.split("needle", " ")
    items = needles.select("item_id", F.col("text").alias("needle")).where("needle is not null").withColumn("key", F.when(F.size(words) >= 5, F.concat_ws(" ", F.slice(words, 2, 3))))
    keyed, short = items.where("key is not null"), items.where("key is null")
    sizes = items.agg(F.sum(F.length("needle")), F.sum(F.when(F.col("key").isNull(), F.length("needle")))).first()
    texts = documents.select("doc_id", "text").where("text is not null").withColumn("at", F.xxhash64("text"))
    token = F.split("text", " ")
    windows = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(F.col("w"), i, 3))))
    met = texts.select("doc_id", "at", token.alias("w")).select("doc_id", "at", F.explode(windows).alias("key")).join(F.broadcast(keyed) if (sizes[0] or 0) <= broadcast_chars else keyed, "key")
    same = F.col("m.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("m.at") == F.col("t.at"))
    found = met.select("doc_id", "at", "item_id", "needle").distinct().alias("m").join(texts.alias("t"), same).where(F.contains("text", "needle")).select("t.doc_id", "item_id")
    slices = -(-(sizes[1] or 0) // short_chars)
    for n in range(slices):
        part = short.where(F.pmod(F.xxhash64("needle"), F.lit(slices)) == n)
        found = found.unionByName(texts.join(F.broadcast(part), F.contains("text", "needle")).select("doc_id", "item_id"))
    return found.distinct()
