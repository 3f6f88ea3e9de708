"""Distributed union-find: connected components of an edge table, without gathering edges anywhere.

Each partition first contracts its own edges with a local union-find; large-star and small-star steps then join the
partitions' trees until all components are stars.  A remainder of at most REMAINDER edges (8 MB) is contracted by one task at once,
as steps of many small tasks would take longer.  Every step is stored in the shared folder, so a lost executor costs one step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import discard, stored

_EDGES = "a bigint, b bigint"
#: Edges that one task contracts; their nodes fit in one run of `_contract`.
REMAINDER = 500_000


class Union:
    """Union-find in one process; a root is the least member of its set."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while x != root:
            self.parent[x], x = root, self.parent.get(x, x)
        return root

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from each node to its root; memory holds the nodes of one run of edges, which is flushed when it grows."""

    def out(union: Union) -> pa.RecordBatch:
        nodes = list(union.parent)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([union.find(n) for n in nodes], pa.int64())], names=["a", "b"])

    union = Union()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            union.join(a, b)
        if len(union.parent) > 1_000_000:
            yield out(union)
            union = Union()
    yield out(union)


def _stars(edges: DataFrame) -> bool:
    """Whether each node has at most one lower neighbour and none that has one itself: then each component is a star."""
    own = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return own.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def _least(edges: DataFrame) -> DataFrame:
    """(n, m): the least neighbour m of each node n that has an edge (a = n).  It is stored, so that a join with it deals out both
    sides anew and Spark can split a node with very many edges."""
    return stored(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m"), "components")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (columns a, b; undirected); component is its least node.  No edges: no rows."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    edges = stored(edges.mapInArrow(_contract, _EDGES).where("a != b").distinct(), "components")
    while True:
        if edges.count() <= REMAINDER:
            whole = stored(edges.coalesce(1).mapInArrow(_contract, _EDGES).where("a != b"), "components")
            discard(edges)
            edges = whole
            break
        if _stars(edges):
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both)
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a != b").distinct()
        large = stored(large, "components")
        discard(edges, least)
        least = _least(large)
        small = large.join(least, F.col("a") == F.col("n")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        edges = stored(small, "components")
        discard(large, least)
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
