"""Hard-negative mining by blocked dense products: blocks of anchors are broadcast against blocks of candidates.

A block of anchors holds BLOCK_CELLS numbers at most, whatever the table's size.  Each task multiplies it with its candidates, a few
rows at a time, and keeps for each anchor the best rows so far; these states merge by ranking, so the shuffle carries a few rows for each anchor
and task and no pair is ever a row.  A first pass finds each anchor's best positives; a second finds, for each of them, the best
rows of other labels whose scores lie in its window.

Components are scaled and floored to integers.  Products are taken in float64, which is exact while every sum stays below 2^53
(bounded by the rows' norms); rows beyond that are multiplied as Python integers, and scores beyond a long are clipped to it.

Rows with a null label, a null vector, or a null or non-finite component take no part.  A vector shorter than others counts as
filled up with zeros.  Rows of equal score come by id, null ids last; rows of equal id are rows of their own, and an anchor that
comes twice gives its rows twice.  A null id is no anchor by the usual predicates.  No anchors, or an empty table, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import discard, give_back, new_path, partitions, remove, stored

POSITIVES, NEGATIVES = 5, 3
#: A negative's score is from LOW to HIGH hundredths of the positive's.
LOW, HIGH = 50, 95
SCALE = 256
#: Numbers in a block of anchors (4 MB), and in a product of it with some candidates.
BLOCK_CELLS, PRODUCT_CELLS = 1 << 19, 1 << 20
#: Below this bound of a sum float64 is exact.
EXACT = float(1 << 52)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
SCHEMA = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


class Best:
    """The k best (score, id) of each key: higher scores first, then smaller ids, null ids last.  States merge by `update`."""

    def __init__(self, keys: int, k: int) -> None:
        self.scores = np.full((keys, k), _LEAST, np.int64)
        self.ids = np.zeros((keys, k), np.int64)
        self.void = np.zeros((keys, k), bool)

    @property
    def least(self) -> np.ndarray:
        """A score below this one cannot enter."""
        return self.scores[:, -1]

    def update(self, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray, void: np.ndarray) -> None:
        if not len(keys):
            return
        touched, k = np.unique(keys), self.scores.shape[1]
        keys = np.concatenate([np.repeat(touched, k), keys])
        scores, ids, void = (np.concatenate([own[touched].ravel(), new]) for own, new in ((self.scores, scores), (self.ids, ids), (self.void, void)))
        order = np.lexsort((ids, void, ~scores, keys))
        keys = keys[order]
        rank = np.arange(len(keys)) - np.searchsorted(keys, keys)
        order, at = order[rank < k], (keys[rank < k], rank[rank < k])
        self.scores[at], self.ids[at], self.void[at] = scores[order], ids[order], void[order]

    def batch(self, names: pa.Array, name: str) -> pa.RecordBatch:
        key, slot = np.nonzero(self.scores > _LEAST)
        ids = pa.array(self.ids[key, slot], mask=self.void[key, slot])
        return pa.RecordBatch.from_arrays([names.take(pa.array(key)), pa.array(self.scores[key, slot]), ids], names=[name, "score", "id"])


@dataclass
class Block:
    """Rows in numpy: own number, id (void where null), label and scaled vector."""

    row: np.ndarray
    ids: np.ndarray
    void: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch | pa.Table, dim: int, scale: int) -> Block:
        if isinstance(batch, pa.Table):
            batch = batch.combine_chunks().to_batches()[0]
        ids, lists = batch.column("id"), batch.column("vector")
        flat = np.floor(float(scale) * lists.flatten().to_numpy(zero_copy_only=False))
        lengths = np.diff(lists.offsets.to_numpy())
        vectors = np.zeros((len(lists), dim))
        vectors[np.arange(dim)[None, :] < lengths[:, None]] = flat
        return cls(batch.column("row").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), batch.column("label").to_numpy(), vectors)

    def take(self, at: np.ndarray | slice) -> Block:
        return Block(self.row[at], self.ids[at], self.void[at], self.labels[at], self.vectors[at])


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all anchors with all rows, as longs."""
    norms = [np.sqrt(np.minimum((x * x).sum(1), 1e300)) for x in (anchors, rows)]
    large = norms[1] * max(norms[0].max(initial=0), 1) >= EXACT
    out = np.empty((len(anchors), len(rows)), np.int64)
    out[:, ~large] = (anchors @ rows[~large].T).astype(np.int64)
    for j in np.flatnonzero(large):
        row = [int(x) for x in rows[j]]
        out[:, j] = [max(_LEAST + 1, min(_MOST, sum(int(a) * b for a, b in zip(anchor, row, strict=True)))) for anchor in anchors]
    return out


def _parts(rows: Block, anchors: int) -> Iterator[Block]:
    step = max(64, PRODUCT_CELLS // max(anchors, 1))
    for start in range(0, len(rows.row), step):
        yield rows.take(slice(start, start + step))


def best_positives(anchors: Block, batches: Iterator[pa.RecordBatch], dim: int, scale: int, k: int) -> Best:
    """Of each anchor the k best other rows of its label."""
    best = Best(len(anchors.row), k)
    own = {label: np.flatnonzero(anchors.labels == label) for label in np.unique(anchors.labels)}
    for batch in batches:
        rows = Block.of(batch, dim, scale)
        for label in np.unique(rows.labels):
            if label not in own:
                continue
            at = own[label]
            for part in _parts(rows.take(rows.labels == label), len(at)):
                scores = products(anchors.vectors[at], part.vectors)
                i, j = np.nonzero((scores >= best.least[at][:, None]) & (anchors.row[at][:, None] != part.row[None, :]))
                best.update(at[i], scores[i, j], part.ids[j], part.void[j])
    return best


def best_negatives(anchors: Block, of: np.ndarray, low: np.ndarray, high: np.ndarray, batches: Iterator[pa.RecordBatch], dim: int, scale: int, k: int) -> Best:
    """Of each window (anchors[of], from low to high) the k best rows of other labels in it."""
    best = Best(len(of), k)
    # Windows are taken in rounds that hold each anchor once at most.
    slot = np.arange(len(of)) - np.searchsorted(of, of)
    rounds = [np.flatnonzero((slot == s) & (low <= high)) for s in range(slot.max(initial=-1) + 1)]
    for batch in batches:
        for part in _parts(Block.of(batch, dim, scale), len(anchors.row)):
            scores = products(anchors.vectors, part.vectors)
            scores[anchors.labels[:, None] == part.labels[None, :]] = _LEAST
            for windows in rounds:
                found = scores[of[windows]]
                least = np.maximum(low, best.least)[windows]
                i, j = np.nonzero((found <= high[windows][:, None]) & (found >= least[:, None]) & (found > _LEAST))
                best.update(windows[i], found[i, j], part.ids[j], part.void[j])
    return best


def _window(score: int, low: int, high: int) -> tuple[int, int]:
    """The longs s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _ranked(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    embeddings: DataFrame, anchor: Column, id_column: str = "vec_id", vector_column: str = "embedding", label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE
) -> DataFrame:
    """For each anchor (rows where `anchor` holds) and each of its best positives the best negatives in its window, ranked from 1.
    label: the label of a row (default: its column "label")."""
    spark = embeddings.sparkSession
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"), (F.col("label") if label is None else label).cast("bigint").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    # Products take longer than reading: the rows are dealt out evenly once.
    rows = stored(rows.repartition(partitions(spark)).withColumn("row", F.monotonically_increasing_id()), "hard-negative-rows")
    some = rows.agg(F.count_if("anchor").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    out = new_path(spark, "hard-negatives")
    spark.createDataFrame([], SCHEMA).write.parquet(out)
    if some.n:
        dim = max(some.dim, 1)
        size = max(1, BLOCK_CELLS // dim)
        blocks = -(-some.n // size)
        anchors = stored(rows.where("anchor").drop("anchor").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")), "hard-negative-anchors", by=["block"])
        for n in range(blocks):
            block = anchors.where(F.col("block") == n).drop("block").toArrow()
            for start in range(0, len(block), size):
                _mine_block(rows, Block.of(block.slice(start, size), dim, scale), dim, scale, positives, negatives, low, high).write.mode("append").parquet(out)
        discard(anchors)
    discard(rows)
    return spark.read.schema(SCHEMA).parquet(out)


def _mine_block(rows: DataFrame, anchors: Block, dim: int, scale: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(anchors)
    columns = rows.select("row", "id", "label", "vector")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield best_positives(sent.value, batches, dim, scale, positives).batch(pa.array(sent.value.row), "row")
        give_back()

    pairs = _ranked(columns.mapInArrow(first, "row bigint, score bigint, id bigint"), ["row"], positives).toArrow()
    place = {row: i for i, row in enumerate(anchors.row.tolist())}
    chosen = sorted((place[r["row"]], r["rank"], r["score"], r["id"]) for r in pairs.to_pylist())
    of = np.array([c[0] for c in chosen], np.int64)
    windows = np.array([_window(c[2], low, high) for c in chosen], np.int64).reshape(-1, 2)
    told = spark.sparkContext.broadcast((of, windows[:, 0].copy(), windows[:, 1].copy()))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield best_negatives(sent.value, *told.value, batches, dim, scale, negatives).batch(pa.array(np.arange(len(told.value[0]))), "pair")
        give_back()

    found = _ranked(columns.mapInArrow(second, "pair bigint, score bigint, id bigint"), ["pair"], negatives)
    told_ids = [(i, None if anchors.void[c[0]] else int(anchors.ids[c[0]]), c[3], c[2]) for i, c in enumerate(chosen)]
    named = spark.createDataFrame(told_ids, "pair bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
    # As many pairs as a block has, so they may be broadcast.
    return found.join(F.broadcast(named), "pair").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: Over `embeddings`, with the query's label rule and anchors.
ORACLE_SQL = """
WITH usable AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, a.label AS anchor_label, b.r, b.vec_id, b.label, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.r <> b.r WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT ar, anchor_id, r, anchor_label, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id NULLS LAST) <= 5
), negatives AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.ar, p.r ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
  FROM positives p JOIN scored s ON s.ar = p.ar AND s.label <> p.anchor_label
  WHERE 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""
