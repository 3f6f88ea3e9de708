"""Prefix trie of conversations: chained digests of every prefix, nodes by (depth, digest), sums over subtrees.

Turns are numbered by range: rows are sorted over all partitions, so a conversation of any length is spread out.  Each turn becomes a digest and
a number of words where it is read; texts are never moved.  Prefix digests are chained in runs of RUN turns, and the runs' ends are chained
in turn: the digest of the first d turns is that of the run's start and of the chain within the run, so long conversations are
chained in parallel and equal sequences still get equal digests.

Sums over subtrees explode every node to its ancestors, along the path of its smallest member, which passes through all of them: what
the nodes of a path hold is summed from its end, run by run, and each prefix of the path brings its sum to its own node.  So a
path of n turns makes n rows, and not one for each pair of node and ancestor.

Rows without a conversation's id belong to none and are left out.  Turns come by number, null first; equal numbers by the digest
of role and text; a null role or text counts as empty; rows that repeat are turns of their own.  Extra columns are ignored; an
empty table gives no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import discard, partitions, stored

#: Turns of a run, and turns of a conversation that share a join key.
RUN, SLAB = 256, 4096
#: Characters of the ids that one row holds while the ends' digests are made.
PIECE = 1 << 16
GAP = r"[\x20\x09-\x0D]+"
NOTHING = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """conv_id, n (from 1), digest and words of each turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where(F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("bigint").alias("conv_id"), "turn", F.unhex(F.sha2(said, 256)).alias("digest"), F.size(F.array_remove(F.split(text, GAP), "")).cast("bigint").alias("words"), F.monotonically_increasing_id().alias("row")
    )
    order = [F.asc_nulls_first("turn"), F.asc("digest"), F.asc("row")]
    dealt = stored(turns.repartitionByRange(partitions(turns.sparkSession), F.asc("conv_id"), *order).withColumn("part", F.spark_partition_id()), "trie-turns")
    own = Window.partitionBy("part", "conv_id").orderBy(*order)
    # Only the first conversation of a part can have turns in parts before: one row a part at most.
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = dealt.groupBy("conv_id", "part").count().withColumn("before", F.sum("count").over(before)).where("before > 0").select("conv_id", "part", "before")
    out = dealt.withColumn("n", F.row_number().over(own)).join(F.broadcast(moved), ["conv_id", "part"], "left")
    out = stored(out.select("conv_id", (F.col("n") + F.coalesce("before", F.lit(0))).alias("n"), "digest", "words"), "trie-numbered")
    discard(dealt)
    return out


def spliced(turns: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Numbered turns whose first `head` (at most `most`) are replaced by those of conversation `base`, as far as it has them; a
    conversation that is its own base stays.  Returns the turns (conv_id, depth, digest, words, ends: whether it is the last one)
    and all conversations (conv_id, length and more)."""
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "n", base.alias("base"), head.alias("head"))
    convs = convs.withColumn("head", F.when(F.col("base") == F.col("conv_id"), 0).otherwise(F.col("head")).cast("bigint"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("head", F.coalesce("base_n", F.lit(0)))
    convs = convs.join(bases, "base", "left").withColumn("taken", taken).withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0)))
    convs = stored(convs.select("conv_id", "n", "base", "head", "taken", "length"), "trie-conversations")
    # A row for each slab of turns, so that no key has more turns than a slab.
    slabs = convs.withColumn("slab", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n") / SLAB))))
    own = turns.withColumn("slab", F.floor(F.col("n") / SLAB)).join(slabs.drop("n"), ["conv_id", "slab"]).where("n > head")
    own = own.select("conv_id", (F.col("n") - F.col("head") + F.col("taken")).alias("depth"), "digest", "words", "length")
    first = turns.where(F.col("n") <= most).withColumnsRenamed({"conv_id": "base", "n": "depth"})
    heads = first.join(convs.where("taken > 0").select("conv_id", "base", "taken", "length"), "base").where("depth <= taken")
    every = own.unionByName(heads.select(*own.columns))
    return every.withColumn("ends", F.col("depth") == F.col("length")).drop("length"), convs


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, run and depth: adds the digest of the run so far (inner) and that before (previous)."""
    at, inner = None, None
    for batch in batches:
        inners, previous = [], []
        for conv_id, run, digest in zip(batch.column("conv_id").to_pylist(), batch.column("run").to_pylist(), batch.column("digest").to_pylist(), strict=True):
            if (conv_id, run) != at:
                at, inner = (conv_id, run), None
            previous.append(inner)
            inner = _digest((inner or b"") + digest)
            inners.append(inner)
        kept = [batch.column(c) for c in ("conv_id", "run", "depth", "words", "ends")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(inners, pa.binary()), pa.array(previous, pa.binary())], names=["conv_id", "run", "depth", "words", "ends", "inner", "previous"])


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last rows of full runs, sorted by conversation and run: the digest that the next run starts from."""
    at, start = None, b""
    for batch in batches:
        conv_ids, runs, starts = batch.column("conv_id").to_pylist(), batch.column("run").to_pylist(), []
        for conv_id, inner in zip(conv_ids, batch.column("inner").to_pylist(), strict=True):
            if conv_id != at:
                at, start = conv_id, b""
            start = _digest(start + inner)
            starts.append(start)
        yield pa.RecordBatch.from_arrays([pa.array(conv_ids, pa.int64()), pa.array([r + 1 for r in runs], pa.int64()), pa.array(starts, pa.binary())], names=["conv_id", "run", "start"])


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for every prefix of every conversation, the empty one included: conv_id, run, depth, digest, parent (digest), words of the last turn,
    ends."""
    runs = turns.withColumn("run", F.floor((F.col("depth") - 1) / RUN)).repartition("conv_id", "run").sortWithinPartitions("conv_id", "run", "depth")
    chained = stored(runs.select("conv_id", "run", "depth", "words", "ends", "digest").mapInArrow(_chain, "conv_id bigint, run bigint, depth bigint, words bigint, ends boolean, inner binary, previous binary"), "trie-chains")
    full = chained.where((F.col("depth") % RUN == 0) & ~F.col("ends")).select("conv_id", "run", "inner").repartition("conv_id").sortWithinPartitions("conv_id", "run")
    starts = full.mapInArrow(_starts, "conv_id bigint, run bigint, start binary")
    none = F.lit(b"")
    rows = chained.where("run = 0").withColumn("start", none).unionByName(chained.where("run > 0").join(starts, ["conv_id", "run"]))
    after = lambda inner: F.unhex(F.sha2(F.concat("start", inner), 256))
    rows = rows.select("conv_id", "run", "depth", after("inner").alias("digest"), F.when(F.col("previous").isNull(), F.col("start")).otherwise(after("previous")).alias("parent"), "words", "ends")
    zero = F.lit(0).cast("bigint")
    roots = convs.select("conv_id", zero.alias("run"), zero.alias("depth"), none.alias("digest"), F.lit(None).cast("binary").alias("parent"), zero.alias("words"), (F.col("length") == 0).alias("ends"))
    out = stored(rows.unionByName(roots), "trie-prefixes")
    discard(chained)
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by digest and id: the ids of each digest, joined in pieces of PIECE characters or so."""
    schema = pa.schema([("digest", pa.binary()), ("least", pa.int64()), ("ids", pa.string())])
    at, ids, length, done = None, [], 0, []

    def close() -> None:
        if ids:
            done.append({"digest": at, "least": ids[0], "ids": ",".join(map(str, ids))})

    for batch in batches:
        for digest, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if digest != at or length > PIECE:
                close()
                at, ids, length = digest, [], 0
            ids.append(conv_id)
            length += 20
        yield pa.RecordBatch.from_pylist(done, schema)
        done.clear()
    close()
    yield pa.RecordBatch.from_pylist(done, schema)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by digest and least id: the digest of all ids of each."""
    schema = pa.schema([("digest", pa.binary()), ("ends_sha256", pa.string())])
    at, running = None, hashlib.sha256()
    for batch in batches:
        done = []
        for digest, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if digest != at:
                if at is not None:
                    done.append({"digest": at, "ends_sha256": running.hexdigest()})
                at, running = digest, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.encode())
        yield pa.RecordBatch.from_pylist(done, schema)
    if at is not None:
        yield pa.RecordBatch.from_pylist([{"digest": at, "ends_sha256": running.hexdigest()}], schema)


def ends_digests(rows: DataFrame) -> DataFrame:
    """digest and ends_sha256 over the ids of the conversations that end there.  A digest of many ids is sorted over many tasks; one
    task then reads its joined pieces, as SHA-256 takes them in order."""
    ended = rows.where("ends").select("digest", "conv_id")
    ordered = ended.repartitionByRange(partitions(rows.sparkSession), "digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    pieces = ordered.mapInArrow(_pieces, "digest binary, least bigint, ids string")
    return pieces.repartition("digest").sortWithinPartitions("digest", "least").mapInArrow(_ends, "digest binary, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of all conversations; see `prefixes` for what it takes.  A turn that n conversations share is saved n - 1 times."""
    key = ["depth", "digest"]
    paths = prefixes(turns, convs)
    nodes = paths.groupBy(*key).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("parent").alias("parent"), F.max("words").alias("words"))
    nodes = stored(nodes, "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes_ = stored(nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))), "trie-children")
    run = F.greatest(F.floor((F.col("depth") - 1) / RUN), F.lit(0).cast("bigint")).alias("run")
    zero = F.lit(0).cast("bigint")
    # A node's own amounts lie on the path of its smallest member; its prefixes get the sums from there to the path's end.
    own = nodes_.select("conv_id", run, "depth", F.lit(None).cast("binary").alias("digest"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("bigint").alias("leaf"))
    rows = paths.select("conv_id", "run", "depth", "digest", zero.alias("saved"), zero.alias("leaf")).unionByName(own)
    below = Window.partitionBy("conv_id", "run").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.select("conv_id", "run", *key, F.sum("saved").over(below).alias("saved"), F.sum("leaf").over(below).alias("leaf")).where("digest is not null")
    runs = own.groupBy("conv_id", "run").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    # Of conversations longer than a run, what their later runs hold; all runs before the last have a row, with amounts or without.
    long = paths.where(F.col("depth") % RUN == 0).where("depth > 0").select("conv_id", "run", zero.alias("saved"), zero.alias("leaf"))
    each = runs.where("run > 0").unionByName(long).groupBy("conv_id", "run").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    after = each.select("conv_id", "run", F.sum("saved").over(later).alias("more_saved"), F.sum("leaf").over(later).alias("more_leaf")).where("more_saved is not null")
    summed = summed.join(after, ["conv_id", "run"], "left")
    sums = summed.groupBy(*key).agg(F.sum(F.col("saved") + F.coalesce("more_saved", zero)).alias("saved_tokens"), F.sum(F.col("leaf") + F.coalesce("more_leaf", zero)).alias("n_leaves"))
    root = nodes_.where("depth = 0").select("conv_id").first()
    above = nodes_.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # The root, under which a node for each first turn hangs, is known; other nodes of many children are split by adaptive execution.
    parents = nodes_.where("depth > 1").join(above, ["depth", "parent"]).unionByName(nodes_.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root.conv_id if root else None).cast("bigint"))))
    out = parents.join(sums, key).join(ends_digests(paths), "digest", "left")
    out = stored(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")), "trie")
    discard(paths, nodes, nodes_)
    return out


#: Over `conversations`, with the query's rule of rebuilding; crc32 is computed bit by bit.
ORACLE_SQL = """
WITH RECURSIVE said AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(concat(length(role), ':', role, text))) AS l FROM said GROUP BY c
), bits(c, s, v, k) AS (
  SELECT c, CAST(c AS VARCHAR), CAST(4294967295 AS BIGINT), 0 FROM own
  UNION ALL
  SELECT c, s, CASE WHEN u & 1 = 1 THEN xor(u >> 1, CAST(3988292384 AS BIGINT)) ELSE u >> 1 END, k + 1
  FROM (SELECT *, CASE WHEN k % 8 = 0 THEN xor(v, CAST(ord(s[k // 8 + 1]) AS BIGINT)) ELSE v END AS u FROM bits WHERE k < 8 * length(s))
), heads AS (SELECT c, xor(v, CAST(4294967295 AS BIGINT)) % 4 AS h FROM bits WHERE k = 8 * length(s)),
rebuilt AS (
  SELECT o.c, CASE WHEN o.c % 20 = 0 THEN o.l ELSE list_concat(coalesce(b.l[1:h], []), o.l[h + 1:]) END AS l
  FROM own o JOIN heads USING (c) LEFT JOIN own b ON b.c = o.c - o.c % 20
), paths AS (SELECT c, d, l[1:d] AS p, len(l) = d AS ends FROM (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, list_sort(list(c) FILTER (ends)) AS ended, len(regexp_extract_all(p[d].text, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM paths GROUP BY d, p
), children AS (SELECT a.d, a.p, count(b.d) AS n_children FROM nodes a LEFT JOIN nodes b ON b.d = a.d + 1 AND b.p[1:a.d] = a.p GROUP BY a.d, a.p),
sums AS (
  SELECT a.d, a.p, sum(CASE WHEN c.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * coalesce(b.words, 0)) AS saved_tokens
  FROM nodes a JOIN nodes b ON b.d >= a.d AND b.p[1:a.d] = a.p JOIN children c ON c.d = b.d AND c.p = b.p GROUP BY a.d, a.p
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(array_to_string(n.ended, ','), '')) AS ends_sha256
FROM nodes n JOIN children USING (d, p) JOIN sums USING (d, p) LEFT JOIN nodes up ON up.d = n.d - 1 AND up.p = n.p[1:n.d - 1]
"""
