"""Items that are alike by exact Jaccard similarity of shingle sets, from candidate links to verified ones.

The connected components of the candidate links hold all candidate pairs.  Among very many items chance links chain unlike ones into
large components; so items of components of more than BLOCK items must meet again, in one of REBANDS longer bands of REROWS minima, to
stay together (a pair at 0.8 does with a probability of 0.999, one at 0.3 with 0.003).  Components are cut into blocks of about BLOCK items
and BLOCK_CHARS code points by a hash, and each pair of blocks is verified in one task, so no component, however large, has to
meet in one task, and no pair is ever a row.  What is moved are the items' texts, not their shingles.  Verified pairs come out
as counts of links for each item and as a spanning forest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import discard, give_back, partitions, stored
from lexmill.llm.components import connected_components
from lexmill.llm.shingles import mix, one_permutation

BLOCK, BLOCK_CHARS = 1024, 1 << 22
REBANDS, REROWS, RESEED = 40, 8, 23
#: Cells of the incidence matrix that a task multiplies at once.
CELLS = 1 << 21
#: From texts to sorted arrays of distinct shingle hashes.
Sets = Callable[[list[str]], list[np.ndarray]]
_FOUND = ("item", "links", "weight_links", "root")


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: an edge from each item to the first one with its key."""
    last, head = None, None
    for batch in batches:
        key, item = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        new = np.concatenate(([key[0] != last if last is not None else True], key[1:] != key[:-1]))
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        first = np.where(at >= 0, item[np.maximum(at, 0)], head if head is not None else 0)
        last, head = key[-1], first[-1]
        edge = first != item
        yield pa.RecordBatch.from_arrays([pa.array(item[edge]), pa.array(first[edge])], names=["a", "b"])


def candidates(keyed: DataFrame) -> DataFrame:
    """(node, component) of all items (columns key, item) that share a key with another item, directly or in a chain."""
    spark = keyed.sparkSession
    runs = keyed.select("key", "item").repartition(partitions(spark), "key").sortWithinPartitions("key", "item")
    return connected_components(runs.mapInArrow(_chain, "a bigint, b bigint"))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets, by products of incidence matrices over slices of their shared shingles."""
    sets = left + right
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.bincount(code, minlength=len(values)) > 1
    column = np.cumsum(often) - 1
    kept = often[code]
    row, column = row[kept], column[code[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    columns = int(column[-1]) + 1 if len(column) else 0
    width = min(max(1, CELLS // len(sets)), columns)
    for start in range(0, columns, max(1, width)):
        a, b = np.searchsorted(column, (start, start + width))
        grid = np.zeros((len(sets), width), np.float32)
        grid[row[a:b], column[a:b] - start] = 1
        out += grid[: len(left)] @ grid[len(left) :].T
    return out


def alike(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    shared = overlaps(left, right).astype(np.float64)
    total = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - shared
    return (shared > 0) & (shared >= threshold * total)


def _roots(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least item of each item's component in a bipartite graph (an item may stand on both sides)."""
    far = np.iinfo(np.int64).max
    rows, columns = left.copy(), right.copy()
    while True:
        new_rows = np.minimum(rows, np.where(near, columns, far).min(1))
        new_columns = np.minimum(columns, np.where(near, new_rows[:, None], far).min(0))
        if (new_rows == rows).all() and (new_columns == columns).all():
            return rows, columns
        rows, columns = new_rows, new_columns


def _verify(threshold: float, sets_of: Sets) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (component, i, j, block, item, weight, text) sorted by the first three: links of each (i, j) group."""

    def one(i: int, j: int, parts: list[pa.RecordBatch]) -> list[np.ndarray] | None:
        table = pa.Table.from_batches(parts)
        item, at = np.unique(table.column("item").to_numpy(), return_index=True)
        block, weight = table.column("block").to_numpy()[at], table.column("weight").to_numpy()[at]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if len(item) < 2 or not len(left) or not len(right):
            return None
        sets = sets_of(table.column("text").take(pa.array(at)).to_pylist())
        near = alike([sets[k] for k in left], [sets[k] for k in right], threshold)
        if i == j:
            np.fill_diagonal(near, False)
        if not near.any():
            return None
        rows, columns = _roots(near, item[left], item[right])
        out = [(item[left], near.sum(1), near @ weight[right], np.minimum(rows, columns) if i == j else rows)]
        if i != j:
            out.append((item[right], near.sum(0), weight[left] @ near, columns))
        linked = [side[1] > 0 for side in out]
        return [np.concatenate([side[k][where] for side, where in zip(out, linked, strict=True)]).astype(np.int64) for k in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], []

        def done() -> None:
            if held and (len(held) > 1 or held[0].num_rows > 1) and (found := one(now[1], now[2], held)):
                ready.append(found)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[k] for r in ready])) for k in range(4)], names=list(_FOUND))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)], strict=True):
                if now != (key := tuple(keys[a].tolist())):
                    done()
                    now, held = key, []
                held.append(batch.slice(a, b - a))
            if len(ready) > 1000:
                yield out()
                ready = []
        done()
        if ready:
            yield out()
        held = []
        give_back()

    return run


def band_keys(minima: np.ndarray, bands: int, salt: np.ndarray | int = 0) -> np.ndarray:
    """(items, bands) keys: each band's minima and its number, mixed."""
    shaped = minima.astype(np.uint64).reshape(len(minima), bands, -1)
    label = (np.arange(bands, dtype=np.uint64) << np.uint64(56)) + np.asarray(salt, np.uint64).reshape(-1, 1)
    label = np.broadcast_to(label, shaped.shape[:2])
    for r in range(shaped.shape[2]):
        label = mix(label * np.uint64(0x100000001B3) + shaped[:, :, r])
    return label.view(np.int64)


def refined(members: DataFrame, sets_of: Sets) -> DataFrame:
    """members (component, item, weight, text; stored) with large components cut into those of items that meet again; items that
    meet none go.  Stored anew."""
    large = stored(members.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("component"), "large")
    if large.isEmpty():
        discard(large)
        return members

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = sets_of(part.column(2).to_pylist())
                at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
                found = band_keys(one_permutation(np.concatenate(sets), at, REBANDS * REROWS, RESEED), REBANDS, mix(part.column(0).to_numpy().view(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(np.repeat(part.column(1).to_numpy(), REBANDS))], names=["key", "item"])
        give_back()

    again = members.join(large, "component", "left_semi").select("component", "item", "text")
    near = stored(candidates(again.mapInArrow(keys, "key bigint, item bigint")), "met-again")
    cut = members.drop("component").join(near.select(F.col("node").alias("item"), "component"), "item")
    out = stored(members.join(large, "component", "left_anti").unionByName(cut), "refined")
    discard(large, near, members)
    return out


def verified(members: DataFrame, sets_of: Sets, threshold: float) -> tuple[DataFrame, DataFrame]:
    """From members (component, item, weight, text; stored) of the candidate components: (item, links, weight_links) and
    (node, component) of the items with links."""
    spark = members.sparkSession
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("chars") / BLOCK_CHARS)).cast("int")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    large = stored(sizes.select("component", blocks.alias("blocks")).where("blocks > 1"), "large-components")
    dealt = members.join(large, "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("item"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "item", "weight", "text")
    groups = dealt.repartition(2 * partitions(spark), "component", "i", "j").sortWithinPartitions("component", "i", "j")
    found = stored(groups.mapInArrow(_verify(threshold, sets_of), "item bigint, links bigint, weight_links bigint, root bigint"), "links")
    discard(large)
    links = found.groupBy("item").agg(F.sum("links").alias("links"), F.sum("weight_links").alias("weight_links"))
    return links, connected_components(found.select(F.col("item").alias("a"), F.col("root").alias("b")))
