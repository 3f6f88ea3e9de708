"""MinHash LSH forest over a table of labels: sorted prefix tries whose matched prefixes are shortened as far as recall needs.

Each item has a label of DEPTH minima in each of TREES trees.  A tree is laid out sorted by its labels, so that every node of its
prefix trie is a run of rows.  FLOOR is the shortest prefix that may be needed: at FLOOR minima in all trees a pair at the
threshold meets with more than the wanted probability.  Prefixes start at their full length.  In a tree where an item's run at
FLOOR holds at most CROWD items the prefix is shortened to FLOOR.  In the trees where the run is crowded (a passage that very many
items share) the prefixes are shortened together, one minimum at a time, and only until the item's probability of meeting a
partner at the threshold in some tree reaches RECALL.  Two items meet in a tree if they share the longer of their prefixes there.
A run is crowded for all its items, and fewer crowded trees mean longer prefixes, so the item with the longer prefix vouches for
the pair's probability.

Runs are read as a stream: a task holds at most CROWD rows and one row a level, however many items share a prefix.  Items are
expected to be distinct.  No rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import discard, give_back, partitions, stored
from lexmill.llm.components import connected_components
from lexmill.llm.shingles import mix

TREES, DEPTH, CROWD, RECALL = 16, 8, 64, 0.999
#: Bytes of a minimum in a label.
WIDTH = 2


def met(threshold: float, depths: list[int]) -> float:
    """Probability that a pair at the threshold shares a prefix of these lengths in some tree."""
    return 1 - math.prod(1 - threshold**d for d in depths)


def floor_depth(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which all trees together reach the recall (1 if none does)."""
    return next((d for d in range(depth, 1, -1) if met(threshold, [d] * trees) >= recall), 1)


def crowded_depth(threshold: float, crowded: int, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """How long the prefixes stay in an item's crowded trees, the others being shortened to the floor."""
    floor = floor_depth(threshold, trees, depth, recall)
    return next((d for d in range(depth, floor, -1) if met(threshold, [floor] * (trees - crowded) + [d] * crowded) >= recall), floor)


def labels(minima: np.ndarray) -> np.ndarray:
    """Rows of minima (items, TREES * DEPTH) as bytes, one label of DEPTH * WIDTH for each tree, in order of trees."""
    short = (mix(minima.astype(np.uint64)) >> np.uint64(48)).astype(">u2")
    return np.ascontiguousarray(short).view(np.uint8).reshape(len(minima), TREES * DEPTH * WIDTH)


def trees_of(items: DataFrame, floor: int) -> DataFrame:
    """(tree, node, label, item) of items (item, label: all trees' bytes); node is the prefix at the floor, hashed with the tree."""
    step = DEPTH * WIDTH
    own = F.expr(f"substring(label, tree * {step} + 1, {step})")
    rows = items.select("item", "label", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("tree", own.alias("label"), "item")
    return rows.select("tree", F.xxhash64("tree", F.expr(f"substring(label, 1, {floor * WIDTH})")).alias("node"), "label", "item")


def _crowds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tree, node, label, item) sorted by node and label: those that are not alone in their run, and whether it is crowded."""
    held: list[pa.RecordBatch] = []  # of the run that is still open, while it holds at most CROWD rows
    open_, size = None, 0

    def said(rows: pa.RecordBatch, crowded: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(crowded)], names=["tree", "node", "label", "item", "crowded"])

    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column(1).to_numpy()
        cut = np.flatnonzero(node[1:] != node[:-1]) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(node)]))
        before = size if open_ == node[0] else 0
        if not before and 1 < size <= CROWD:
            yield from (said(h, np.zeros(h.num_rows, bool)) for h in held)
        if not before:
            held = []
        total = ends - starts
        total[0] += before
        if before and total[0] > CROWD and before <= CROWD:
            yield from (said(h, np.ones(h.num_rows, bool)) for h in held)
            held = []
        elif before and len(starts) > 1 and held:  # the open run ends here and is small
            yield from (said(h, np.zeros(h.num_rows, bool)) for h in held)
            held = []
        last = np.zeros(len(starts), bool)
        last[-1] = True
        now = np.where(last & (total <= CROWD), False, total > 1)  # the last run may go on
        rows = np.repeat(now, ends - starts)
        if rows.any():
            yield said(batch.filter(pa.array(rows)), np.repeat(total > CROWD, ends - starts)[rows])
        open_, size = node[-1], int(total[-1])
        if size <= CROWD:
            held.append(batch.slice(int(starts[-1])))
    if 1 < size <= CROWD:
        yield from (said(h, np.zeros(h.num_rows, bool)) for h in held)
    give_back()


def _meet(floor: int):
    """Rows (tree, node, label, depth, item) sorted by node and label: edges between neighbours at each prefix length, among the
    items whose prefix there is no longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, tuple[int, bytes, int]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            node, depth, item = (batch.column(k).to_numpy() for k in (1, 3, 4))
            text = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, DEPTH * WIDTH)
            out = []
            for d in range(floor, DEPTH + 1):
                at = np.flatnonzero(depth <= d)
                if not len(at):
                    continue
                prefix, n, own = text[at, : d * WIDTH], node[at], item[at]
                same = (n[1:] == n[:-1]) & (prefix[1:] == prefix[:-1]).all(1)
                out.append((own[1:][same], own[:-1][same]))
                if d in last and last[d][0] == n[0] and last[d][1] == prefix[0].tobytes():
                    out.append((own[:1], np.array([last[d][2]])))
                last[d] = int(n[-1]), prefix[-1].tobytes(), int(own[-1])
            if out:
                a, b = (np.concatenate([o[k] for o in out]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        give_back()

    return run


def candidates(items: DataFrame, threshold: float) -> DataFrame:
    """(node, component) of items (item, label; stored) that meet another one in some tree, directly or in a chain."""
    parts, floor = partitions(items.sparkSession), floor_depth(threshold)
    runs = trees_of(items, floor).repartition(parts, "node").sortWithinPartitions("node", "label", "item")
    matched = stored(runs.mapInArrow(_crowds, "tree int, node bigint, label binary, item bigint, crowded boolean"), "forest")
    # One number of crowded trees for each item, and with it the length of its prefixes there.
    crowds = stored(matched.where("crowded").groupBy("item").agg(F.count(F.lit(1)).alias("n")), "forest-crowds")
    depth = F.element_at(F.array(*(F.lit(crowded_depth(threshold, c)) for c in range(1, TREES + 1))), F.col("n").cast("int"))
    deep = matched.where("crowded").join(crowds, "item").select("tree", "node", "label", depth.alias("depth"), "item")
    rows = matched.where("not crowded").select("tree", "node", "label", F.lit(floor).alias("depth"), "item").union(deep)
    edges = rows.repartition(parts, "node").sortWithinPartitions("node", "label", "item").mapInArrow(_meet(floor), "a bigint, b bigint")
    out = connected_components(edges)
    discard(matched, crowds)
    return out
