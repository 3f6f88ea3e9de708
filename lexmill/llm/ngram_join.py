"""N-gram Jaccard self-join of documents: MinHash LSH forest (``forest``), then exact verification.

Shingles are NGRAM consecutive lower-case words (runs of characters other than space and 9 to 13); a text of fewer words has
one, of all its words.  Texts of equal shingle sets are one item; items that meet in the forest are verified on their exact
shingle sets.

Rows: one for each document with class_id (the least doc_id of its class; null if all are null), n_links (documents alike,
copies counted) and n_text_links (different shingle sets alike).  Texts without words, null ones too, are alike to each
other and to nothing else; texts of equal shingle sets have similarity 1; extra columns are ignored (and kept, whatever their
names, by ``keep_one``); no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import forest
from lexmill.llm.common import discard, give_back, stored, texts_of
from lexmill.llm.shingles import minhash, multipliers, slices, word_shingles
from lexmill.llm.similarity import refined, verified

NGRAM, THRESHOLD, SEED = 5, 0.8, 11
NO_ID = -(1 << 63)


def sets_of(n: int):
    """From texts to the sorted distinct hashes of their shingles of n words."""

    def of(texts: list[str]) -> list[np.ndarray]:
        out = []
        for _, raws in slices(t and t.lower() for t in texts):
            shingles, at = word_shingles(raws, n)
            out += [np.unique(shingles[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        return out

    return of


def _item(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _keyed(documents: DataFrame) -> list:
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")]


def signatures(documents: DataFrame, n: int = NGRAM) -> DataFrame:
    """id (null: NO_ID), text_hash, item (a hash of the shingle set) and the forest's label of each document (null: no words)."""
    functions = multipliers(forest.TREES * forest.DEPTH, SEED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, labels = [], []
            for _, raws in slices(t and t.lower() for t in texts_of(batch.column(2))):
                shingles, at = word_shingles(raws, n)
                full = np.flatnonzero(np.diff(at) > 0)
                own: list[bytes | None] = [None] * len(raws)
                if len(full):
                    for i, label in zip(full.tolist(), forest.labels(minhash(shingles, np.append(at[:-1][full], at[-1]), functions)), strict=True):
                        own[i] = label.tobytes()
                items += [_item(np.unique(shingles[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]
                labels += own
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(items, pa.int64()), pa.array(labels, pa.binary())], names=["id", "text_hash", "item", "label"])
        give_back()

    return documents.select(*_keyed(documents), "text").mapInArrow(run, "id bigint, text_hash bigint, item bigint, label binary")


def classes(documents: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """id, text_hash, item, class (an item), class_id, links and weight_links of each document."""
    signed = stored(signatures(documents, n), "ngram-signatures")
    items = stored(signed.groupBy("item").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("id", "text_hash")).alias("first"), F.first("label").alias("label")), "ngram-items")
    near = stored(forest.candidates(items.where("label is not null").select("item", "label"), threshold), "ngram-candidates").withColumnRenamed("node", "item")
    chosen = stored(near.join(items, "item").select("item", "component", "weight", "first.id", "first.text_hash"), "ngram-chosen")
    texts = documents.select(*_keyed(documents), F.coalesce("text", F.lit("")).alias("text"))
    # Rows equal in id and text are one item's text, which is moved once for all of them.
    if not signed.groupBy("id", "text_hash").count().where("count > 1").isEmpty():
        texts = texts.groupBy("id", "text_hash").agg(F.first("text").alias("text"))
    # By shuffle at every size: what is chosen grows with the documents.
    members = stored(texts.join(chosen.hint("merge"), ["id", "text_hash"]).select("component", "item", "weight", "text"), "ngram-members")
    discard(chosen)
    members = refined(members, sets_of(n))
    links, linked = verified(members, sets_of(n), threshold)
    linked = stored(linked, "ngram-components")
    of = items.select("item", "weight", F.when(F.col("first.id") != NO_ID, F.col("first.id")).alias("least"))
    of = of.join(linked.select(F.col("node").alias("item"), "component"), "item", "left").join(links, "item", "left").withColumn("class", F.coalesce("component", "item"))
    of = stored(of, "ngram-linked")
    discard(members, linked)
    ids = stored(of.groupBy("class").agg(F.min("least").alias("class_id")), "ngram-ids")
    of = stored(of.join(ids, "class").select("item", "class", "class_id", F.coalesce("links", F.lit(0)).alias("links"), (F.coalesce("weight_links", F.lit(0)) + F.col("weight") - 1).alias("weight_links")), "ngram-classes")
    return signed.drop("label").join(of, "item")


def join(documents: DataFrame) -> DataFrame:
    found = classes(documents)
    return found.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "class_id", F.col("weight_links").alias("n_links"), F.col("links").alias("n_text_links"))


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents with all their columns, one for each class: that of least id (then text hash)."""
    found = stored(classes(documents), "ngram-found")
    kept = stored(found.groupBy("class").agg(F.min(F.struct("id", "text_hash")).alias("k")).select("k.id", "k.text_hash"), "ngram-kept")
    repeated = found.groupBy("id", "text_hash").count().where("count > 1").limit(1).count() > 0
    own = documents.select(*_keyed(documents), F.struct(*(documents[c] for c in documents.columns)).alias("row"))
    out = own.join(kept, ["id", "text_hash"], "left_semi")
    out = out.dropDuplicates(["id", "text_hash"]) if repeated else out
    return out.select(*(F.col("row").getField(c).alias(c) for c in documents.columns))
