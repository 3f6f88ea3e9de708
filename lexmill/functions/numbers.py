"""Decision anchors to (year, number) pairs, natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns: where a text is cut into clauses, a clause, and a range of numbers in its list.
_CUT = r"(?i)\s*&\s*(?=AAB\b)"
_CLAUSE = r"(?i)^\s*AAB\s+(.*?)\s*[-/]\s*(\d{4})\s*$"
_RANGE = r"^(\d+)\s*-\s*(\d+)$"
#: Numbers of a range that are laid out at once.
_RUN = 1000


def number_pairs(anchors: DataFrame, text: Column) -> DataFrame:
    """anchors with a row for each pair (year, num) that the text names.  Remarks in brackets go, ranges are expanded (a reversed one
    is empty), parts of a list that are neither a number nor a range go, and texts without pairs go."""
    clean = F.trim(F.regexp_replace(text, r"\([^)]*\)", ""))
    clauses = anchors.withColumn("_clause", F.explode(F.split(clean, _CUT))).where(F.col("_clause").rlike(_CLAUSE))
    parsed = clauses.withColumn("year", F.regexp_extract("_clause", _CLAUSE, 2).cast("int")).withColumn("_list", F.regexp_extract("_clause", _CLAUSE, 1))
    parts = parsed.withColumn("_part", F.explode(F.split("_list", "[,&]"))).withColumn("_part", F.trim("_part"))
    range_, single = F.col("_part").rlike(_RANGE), F.col("_part").rlike(r"^\d+$")
    low = F.when(range_, F.regexp_extract("_part", _RANGE, 1)).when(single, F.col("_part")).try_cast("bigint")
    high = F.when(range_, F.regexp_extract("_part", _RANGE, 2)).when(single, F.col("_part")).try_cast("bigint")
    spans = parts.withColumns({"_low": low, "_high": high}).where("_low <= _high")
    runs = spans.withColumn("_at", F.explode(F.sequence("_low", "_high", F.lit(_RUN).cast("bigint"))))
    return runs.withColumn("num", F.explode(F.sequence("_at", F.least(F.col("_at") + _RUN - 1, F.col("_high"))))).drop("_clause", "_list", "_part", "_low", "_high", "_at")


def decisions(anchors: DataFrame) -> DataFrame:
    """(year, num) -> filename, chinese_only and partners of an index (position, href, text).  Only files AAB*.pdf count; partners are
    the other pairs of the same anchor, sorted; the last anchor of a pair wins."""
    wanted = anchors.where(F.col("href").rlike(r"(?i)^files/AAB.*\.pdf$"))
    pairs = number_pairs(wanted, F.col("text")).select("position", "href", "text", "year", "num")
    together = pairs.groupBy("position").agg(F.sort_array(F.collect_set(F.struct("year", "num"))).alias("all"))
    rows = pairs.join(together, "position").withColumn("partners", F.array_remove("all", F.struct("year", "num")))
    chosen = rows.groupBy("year", "num").agg(F.max_by(F.struct("href", "text", "partners"), "position").alias("e"))
    return chosen.select("year", "num", F.element_at(F.split("e.href", "/"), -1).alias("filename"), F.contains("e.text", F.lit("Chinese version only")).alias("chinese_only"), F.col("e.partners").alias("partners"))


def resolved(rows: DataFrame, index: DataFrame, title_number: Column) -> DataFrame:
    """rows (year, num) with the index's filename: by their own number, else by the number in their title (null: by neither)."""
    own = index.select("year", F.col("num").alias("_n"), F.col("filename").alias("_own"))
    other = index.select("year", F.col("num").alias("_t"), F.col("filename").alias("_other"))
    keyed = rows.withColumns({"_n": F.col("num").cast("bigint"), "_t": title_number.cast("bigint")})
    return keyed.join(own, ["year", "_n"], "left").join(other, ["year", "_t"], "left").withColumn("filename", F.coalesce("_own", "_other")).drop("_n", "_t", "_own", "_other")
