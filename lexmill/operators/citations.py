"""The citation graph beyond walks: hubs, partners, caps by their suffix, chains of appeal, aliases and authority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hubs(edges: DataFrame, court: str | None = None, least: int = 1, limit: int | None = None) -> DataFrame:
    """(to_key, inbound): cases that most others cite, of a court (the first part of a key) if one is named; ties by key."""
    rows = edges.select("from_key", "to_key").distinct().groupBy("to_key").agg(F.count(F.lit(1)).alias("inbound")).where(F.col("inbound") >= least)
    rows = rows if court is None else rows.where(F.split_part(F.col("to_key").cast("string"), F.lit("/"), F.lit(1)) == court)
    return rows if limit is None else rows.orderBy(F.desc("inbound"), "to_key").limit(limit)


def partner_counts(edges: DataFrame) -> DataFrame:
    """(from_key, to_key, partners): how many other targets each edge's source has; edges without any go.  One aggregation and a join
    by the source: linear, however many targets it has."""
    own = edges.select("from_key", "to_key").distinct()
    sizes = own.groupBy("from_key").agg((F.count(F.lit(1)) - 1).alias("partners")).where("partners > 0")
    return own.join(sizes, "from_key")


def caps(edges: DataFrame) -> DataFrame:
    """(parent, child, derived): adjacency of ordinances and regulations, and whether the child's number alone tells its parent."""
    number = F.regexp_extract("child_cap", r"^(\d+)[A-Za-z]+$", 1)
    return edges.select(F.col("parent_cap").alias("parent"), F.col("child_cap").alias("child"), (number == F.col("parent_cap")).alias("derived"))


def appeal_chain(histories: DataFrame, body: str = "body") -> DataFrame:
    """(keys, step, caseno, date): the steps of each case's history (a JSON list), in order."""
    keys = [c for c in histories.columns if c != body]
    rows = histories.select(*keys, F.posexplode(F.from_json(body, "array<struct<caseno:string,date:string>>")).alias("step", "e"))
    return rows.select(*keys, "step", "e.caseno", "e.date")


def canonical(cites: DataFrame, aliases: DataFrame) -> DataFrame:
    """cites (cite) with case_key: that of an alias (parallel_cite, case_key; of several the least), else the citation itself."""
    one = aliases.groupBy(F.col("parallel_cite").alias("cite")).agg(F.min("case_key").alias("_key"))
    return cites.join(one, "cite", "left").withColumn("case_key", F.coalesce("_key", "cite")).drop("_key")


def authority(similarity: Column, inbound: Column, court_weight: Column, years: Column, alpha: float = 0.1, beta: float = 0.2, gamma: float = 0.1, decay: float = 0.05) -> Column:
    """similarity + alpha log(1 + inbound) + beta court + gamma exp(-decay years)."""
    return similarity + alpha * F.log1p(inbound.cast("double")) + beta * court_weight + gamma * F.exp(-decay * years)
