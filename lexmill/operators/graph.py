"""Walks over edge tables: neighbourhoods and shortest paths by frontiers, each hop one join and one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import written


def undirected(edges: DataFrame) -> DataFrame:
    """(node, other) in both directions, each once, from edges with from_key and to_key."""
    there = edges.select(F.col("from_key").alias("node"), F.col("to_key").alias("other"))
    return there.unionByName(edges.select(F.col("to_key").alias("node"), F.col("from_key").alias("other"))).where("node != other").distinct()


def shortest_paths(edges: DataFrame, seeds: DataFrame, hops: int = 6) -> DataFrame:
    """(node, hop, via) of all nodes within so many undirected hops of the seeds (column node): the least number of hops, and
    the least node before it on a shortest path (null for seeds).  Following via from a node to a seed gives a path.  Each hop is
    written, so its plan stays as small as the first one's."""
    both = written(undirected(edges), "edges")
    frontier = seeds.select("node").distinct().select("node", F.lit(0).alias("hop"), F.lit(None).cast("bigint").alias("via"))
    seen = frontier = written(frontier, "hop-0")
    for hop in range(1, hops + 1):
        reached = frontier.select("node").join(both, "node").groupBy(F.col("other").alias("reached")).agg(F.min("node").alias("via"))
        new = reached.withColumnRenamed("reached", "node").join(seen.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hop"), "via")
        frontier = written(new, f"hop-{hop}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
