"""Fuzzy line dedup: MinHash over character shingles, high-recall banding, exact Jaccard verification, union-find.

Lines are split at "\\n".  Shingles are SHINGLE consecutive code points (a shorter line is one shingle); one-permutation
MinHash with BANDS bands of ROWS minima meets a pair of similarity 0.8 with a probability of 0.996 (0.9 with 0.999999).  Lines at 0.8 or more
are linked, and of each component the first line (by doc_id, text hash, line number) stays.  Equal lines are one item: it is
hashed once for each batch of lines, whatever its number of copies, and its text is moved once.

Blank lines always stay.  Null texts have no lines; rows equal in id and text count as one document and are treated alike; a
null id orders first; extra columns are ignored (and kept, whatever their names, by ``dedup``); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import discard, give_back, stored
from lexmill.llm.shingles import char_shingles, one_permutation
from lexmill.llm.similarity import band_keys, candidates, refined, verified

SHINGLE, THRESHOLD, BANDS, ROWS, SEED = 8, 0.8, 14, 5, 5
NO_ID = -(1 << 63)
#: Code points of lines that are hashed at once.
CHUNK = 1 << 16


def _chunks(lines: list[str]) -> Iterator[list[str]]:
    start = size = 0
    for i, line in enumerate(lines):
        size += len(line)
        if size > CHUNK:
            yield lines[start : i + 1]
            start, size = i + 1, 0
    if start < len(lines):
        yield lines[start:]


def lines_of(documents: DataFrame) -> DataFrame:
    """id, text_hash, line_no (from 0), line and item (a hash of the line), without blank lines."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return rows.where(F.btrim("line", F.lit(" \t\r\x0b\x0c")) != "").withColumn("item", F.xxhash64("line"))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        item, at = np.unique(batch.column(0).to_numpy(), return_index=True)
        place = 0
        for lines in _chunks(batch.column(1).take(pa.array(at)).to_pylist()):
            shingles, first = char_shingles(lines, SHINGLE)
            keys = band_keys(one_permutation(shingles, first, BANDS * ROWS, SEED), BANDS)
            own = item[place : place + len(lines)]
            place += len(lines)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(own, BANDS))], names=["key", "item"])
    give_back()


def sets_of(lines: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each line."""
    out = []
    for some in _chunks(lines):
        shingles, at = char_shingles(some, SHINGLE)
        out += [np.unique(shingles[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def kept_lines(documents: DataFrame) -> DataFrame:
    """id, text_hash, line_no, component and kept of each line that is not blank."""
    lines = lines_of(documents)
    near = stored(candidates(lines.select("item", "line").mapInArrow(_keys, "key bigint, item bigint")), "line-candidates")
    text = lines.groupBy("item").agg(F.min("line").alias("text")).join(near, F.col("item") == F.col("node"))
    members = stored(text.select("component", "item", F.lit(1).cast("bigint").alias("weight"), "text"), "line-members")
    discard(near)
    members = refined(members, sets_of)
    _, linked = verified(members, sets_of, THRESHOLD)
    of = stored(linked.select(F.col("node").alias("item"), "component"), "line-linked")
    discard(members)
    rows = stored(lines.drop("line").join(of, "item", "left").select("id", "text_hash", "line_no", F.coalesce("component", "item").alias("component")), "lines")
    discard(of)
    first = stored(rows.groupBy("component").agg(F.min(F.struct("id", "text_hash", "line_no")).alias("first")), "line-firsts")
    # Stored, so that nothing above the join keeps Spark from splitting a very common component.
    return stored(rows.join(first, "component").withColumn("kept", F.struct("id", "text_hash", "line_no") == F.col("first")).drop("first"), "kept-lines")


def _removed(documents: DataFrame) -> DataFrame:
    """id, text_hash, lines that are not blank, and the sorted numbers of those that go."""
    # Sets of line numbers, as rows equal in id and text have the same lines.
    gone = F.collect_set(F.when(~F.col("kept"), F.col("line_no")))
    return kept_lines(documents).groupBy("id", "text_hash").agg(F.size(F.collect_set("line_no")).alias("lines"), F.sort_array(gone).alias("removed"))


def _own(documents: DataFrame) -> list:
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")]


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines (not blank), n_kept and the numbers of the removed lines of each document."""
    out = documents.select(*_own(documents)).join(_removed(documents), ["id", "text_hash"], "left")
    n, removed = F.coalesce("lines", F.lit(0)).cast("bigint"), F.coalesce("removed", F.array().cast("array<int>"))
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), n.alias("n_lines"), (n - F.size(removed)).alias("n_kept"), removed.alias("removed_lines"))


def dedup(documents: DataFrame) -> DataFrame:
    """The documents with their columns and without the removed lines."""
    own = documents.select(*_own(documents), F.struct(*(documents[c] for c in documents.columns)).alias("row"))
    left = F.filter(F.split("row.text", "\n"), lambda _, i: ~F.coalesce(F.array_contains("removed", i), F.lit(False)))
    out = own.join(_removed(documents), ["id", "text_hash"], "left").withColumn("left", F.array_join(left, "\n"))
    return out.select(*(F.col("left").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in documents.columns))
