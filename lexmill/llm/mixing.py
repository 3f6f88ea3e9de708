"""Mixing sources to target weights by capped water-filling and seeded repetitions.

Sizes are words.  The mix takes SHARE of all words, shared among the sources by weight; no source gives more than CAP times
its own size, and what one cannot give is shared again among the others by weight.  The end of that is one water level: a
source's target is the smaller of its cap and its weight times the level, and the level is found in closed form from sums
over the sources in order of cap over weight.  A source whose target is whole times its size plus a rest gives each
document whole times, and once more those documents that come first in the order of a seeded hash, up to the rest.

The hash order is cut without gathering a source: sums of 4,096 hash ranges come first, then only rows of one range of
one source meet in a task.  One row for each source meets in one task (for ranks and the level).

Null texts have size 0 and are taken whole times only; null sources form a source that ranks last; a null id hashes as empty
text; the text is hashed too, so rows of one id are told apart; rows equal in id, source and text are taken alike; extra columns are ignored (and kept by ``mix``); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import small, stored

SHARE, CAP, WEIGHTS, SEED = 1.5, 2, (3, 1, 2), "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def _sized(documents: DataFrame) -> list[Column]:
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return [
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("size"),
        F.md5(F.concat(F.lit(f"{SEED}:"), key, F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary")).alias("_hash"),
        key.alias("_key"),
    ]


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target: one row for each source."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weights = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    ranked = sources.select("source", "source_size", weights.cast("double").alias("weight"), (F.lit(SHARE) * F.sum("source_size").over(everything)).alias("total"), (F.lit(float(CAP)) * F.col("source_size")).alias("cap"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    below = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    above = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = (F.col("total") - below) / above
    at = ranked.withColumn("level", level)
    held = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(everything)
    return at.select("source", "source_size", F.least("cap", F.col("weight") * F.coalesce(held, F.lit(0.0))).alias("target"))


def plan(sized: DataFrame) -> DataFrame:
    """For each source its size, target, whole repetitions and the last (hash, key, size) that is taken once more."""
    source = stored(targets(sized).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    rows = sized.select("source", "size", "_hash", "_key", F.substring("_hash", 1, 3).alias("_range"))
    # One exchange: the ranges of a source are dealt out, and both the sums and the order within a range use that deal.
    within = Window.partitionBy("source", "_range").orderBy("_hash", "_key", "size")
    upto = rows.withColumn("_upto", F.sum("size").over(within))
    ranges = rows.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("source").orderBy("_range")) - F.col("_sum")
    ranges = ranges.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), before.alias("_before"))
    ranges = ranges.join(small(source.select(F.col("source").alias("_t"), "rest"), source), F.col("_s").eqNullSafe(F.col("_t"))).where((F.col("rest") > 0) & (F.col("_before") <= F.col("rest")))
    taken = upto.join(ranges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r"))).where(2.0 * (F.col("_before") + F.col("_upto")) - F.col("size") <= 2.0 * F.col("rest"))
    cut = taken.groupBy(F.col("source").alias("_c")).agg(F.max(F.struct("_hash", "_key", "size")).alias("cut"))
    return source.join(cut, F.col("source").eqNullSafe(F.col("_c")), "left").drop("_c")


def _planned(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """rows with _times: how often the mix takes each."""
    of = stored(plan(sized).withColumnRenamed("source", "_source"), "mix-plan")
    again = (F.coalesce(F.struct("_hash", "_key", "size") <= F.col("cut"), F.lit(False)) & (F.col("size") > 0)).cast("bigint")
    return rows.join(small(of), F.col("source").eqNullSafe(F.col("_source"))).withColumn("_times", F.col("whole") + again)


def amounts(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row."""
    sized = stored(documents.select("doc_id", "source", *_sized(documents)), "mix-sizes")
    return _planned(sized, sized).select(F.col("doc_id").cast("bigint").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("_times")).alias("taken"))


def mix(documents: DataFrame) -> DataFrame:
    """The mixed corpus: each row as often as the mix takes it, with its own columns."""
    columns = [F.col(f"row.{c}").alias(c) for c in documents.columns]
    packed = documents.select("doc_id", "source", F.struct(*documents.columns).alias("row"), *_sized(documents))
    sized = stored(packed.drop("row"), "mix-sizes")
    taken = _planned(packed, sized).where("_times > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("_times").cast("int")))).select(*columns)


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         coalesce(CAST(doc_id AS VARCHAR), '') AS k, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight,
             {SHARE} * CAST(sum(source_size) OVER () AS DOUBLE) AS total, 2.0 * CAST(source_size AS DOUBLE) AS cap FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, weight * coalesce(max(CASE WHEN level <= cap / weight THEN level END) OVER (), 0.0)) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
c AS (SELECT d.doc_id, d.size, CAST(r.source_size AS BIGINT) AS source_size, r.target, r.whole, r.target - r.whole * r.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.k, d.size) AS upto
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN rest > 0 AND 2.0 * upto - size <= 2.0 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
