"""Token-ID output: whole texts as frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank in the corpus (commonest first), so most take one byte.  A shard holds the documents of one
range of doc_id in ascending order (null ids first, equal ids by a hash of the text) as blocks of

    magic "LXT1" | documents, ids, control bytes, data bytes (uint64) | doc_id, null flag, length of each document
    | control bytes: two bits an id, its bytes less one, four ids to a control byte | data bytes, little-endian

and a reader decodes a block with numpy table lookups on the control bytes.  ``ranks.bin`` (uint32 id of each rank) stands
beside the shards.  Shards are written under a temporary name and then moved, so a task that runs again replaces the same
file.  Null and empty texts hold the end id alone; repeated rows are each written; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import new_path, partitions, stored

END, MAGIC, BLOCK_IDS = 2, b"LXT1", 1 << 20
#: Distinct words whose ids a worker keeps; beyond that it starts afresh.
CACHED = 1 << 20
#: Bytes of texts, or of ids, that are worked on at once; a longer text makes a longer run.
SLICE = 1 << 22
#: Letters whose words no normaliser changes in length or order, and marks that are parted from such a letter before space.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?%#*&"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Encodes texts by their white-space-delimited words, each distinct word once: this tokenizer drops white space and
    none of its steps reaches across it, nor from a Latin letter to plain marks at a word's end."""

    def __init__(self, tokenizer: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.size = max(self.tokenizer.get_vocab_size(with_added_tokens=True), END + 1)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        #: Ids that end a run of letters; such runs can be encoded many at a time and parted again.
        self.last = np.zeros(self.size, bool)
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.entry: dict[str, int] = {}
        self.flat = np.array([END], self.kind)
        self.start, self.length = np.zeros(1, np.int32), np.ones(1, np.int32)  # entry 0 is the end

    def add(self, words: list[str]) -> None:
        ids, count = self.encoded(words)
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(count, dtype=np.int32) - count))
        self.length = np.concatenate((self.length, count))
        self.flat = np.concatenate((self.flat, ids))
        self.entry.update(zip(words, range(len(self.start) - len(words), len(self.start)), strict=True))

    def batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has."""
        plain = pc.match_substring_regex(pa.array(words, pa.string()), f"^[{LETTERS}]+$").to_numpy(zero_copy_only=False)
        many = [words[i] for i in np.flatnonzero(plain)]
        joined = np.fromiter(chain.from_iterable(self.batch([" ".join(many[k : k + 200]) for k in range(0, len(many), 200)])), self.kind)
        stop = np.flatnonzero(self.last[joined]) + 1
        if len(stop) != len(many) or len(joined) != (stop[-1] if len(stop) else 0):
            plain[:] = False
            joined, stop = joined[:0], stop[:0]
        single = self.batch([words[i] for i in np.flatnonzero(~plain)])
        count = np.empty(len(words), np.int32)
        count[plain] = np.diff(stop, prepend=0)
        count[~plain] = [len(x) for x in single]
        out = np.empty(int(count.sum()), self.kind)
        of_plain = np.repeat(plain, count)
        out[of_plain] = joined
        out[~of_plain] = np.fromiter(chain.from_iterable(single), self.kind)
        return out, count

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, with the end of each text, and the number for each text."""
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, f"([{LETTERS}])([{MARKS}]+)([ \\t\\n])", r"\1 \2\3"))
        coded = split.flatten().dictionary_encode()
        keys = coded.dictionary.to_pylist()
        if len(self.entry) + len(keys) > CACHED:
            self.clear()
        if new := [k for k in keys if k not in self.entry]:
            self.add(new)
        at = np.fromiter(map(self.entry.__getitem__, keys), np.int64, len(keys))
        first = split.offsets.to_numpy() - split.offsets[0].as_py()
        entry = np.insert(at[coded.indices.to_numpy()], first[1:], 0)
        length = self.length[entry]
        upto = np.cumsum(length, dtype=np.int32)
        ids = self.flat[np.arange(upto[-1], dtype=np.int32) + np.repeat(self.start[entry] - upto + length, length)]
        return ids, np.diff(upto[first[1:] + np.arange(len(texts))], prepend=0)


def runs(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in runs of about SLICE bytes."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy()) // SLICE
    edge = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(texts)]
    yield from (texts.slice(a, b - a) for a, b in pairwise(edge) if b > a)


@cache
def encoder(tokenizer: str) -> Encoder:
    """This worker's encoder."""
    return Encoder(tokenizer)


_CODES = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3
#: For each control byte: bytes of its four ids, where each begins, and all of them.
WIDTHS = _CODES + 1
STARTS = np.cumsum(WIDTHS, 1) - WIDTHS
TOTALS = WIDTHS.sum(1)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of uint32 values."""
    values = values.astype("<u4")
    padded = np.concatenate((values, np.zeros(-len(values) % 4, "<u4")))
    code = (padded > 0xFF).astype(np.uint8) + (padded > 0xFFFF) + (padded > 0xFFFFFF)
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    kept = np.arange(4) <= code[:, None]
    return control.tobytes(), padded.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    control = np.frombuffer(control, np.uint8)
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    total = TOTALS[control]
    at = ((np.cumsum(total) - total)[:, None] + STARTS[control]).ravel()
    width = WIDTHS[control].ravel()
    out = raw[at].astype(np.uint32)
    for j in range(1, 4):
        longer = np.flatnonzero(width > j)
        out[longer] |= raw[at[longer] + j].astype(np.uint32) << np.uint32(8 * j)
    return out[:n]


def block(doc_ids: list[int | None], lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    head = np.array([len(doc_ids), len(ranks), len(control), len(data)], "<u8").tobytes()
    return b"".join((MAGIC, head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(), lengths.astype("<u8").tobytes(), control, data))


def blocks(stream) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    while head := stream.read(36):
        if head[:4] != MAGIC:
            raise ValueError("not a token shard")
        docs, n, controls, size = np.frombuffer(head[4:], "<u8").tolist()
        ids = np.frombuffer(stream.read(8 * docs), "<i8").tolist()
        absent = stream.read(docs)
        lengths = np.frombuffer(stream.read(8 * docs), "<u8").astype(np.int64)
        yield [None if gone else d for d, gone in zip(ids, absent, strict=True)], lengths, unpack(stream.read(controls), stream.read(size), n)


def encoded(documents: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, a hash of the text and the ids (binary) of each document."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in runs(batch.column(2)):
                ids, lengths = encoder(tokenizer).ids(texts)
                offset = np.concatenate(([0], np.cumsum(lengths))) * ids.itemsize
                packed = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offset.astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), packed.cast(pa.binary())], names=["doc_id", "hash", "ids"])
                at += len(texts)

    return docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(run, "doc_id bigint, hash bigint, ids binary")


def write(documents: DataFrame, path: str, tokenizer: str | None = None) -> list[tuple[int, int]]:
    """Writes the shards of all documents to path; returns (documents, ids) of each shard in order.  Texts are encoded once;
    their ids are stored, counted, and then ranked and written."""
    tokenizer = tokenizer or default_tokenizer()
    docs = stored(encoded(documents, tokenizer), "token-ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, total = encoder(tokenizer).kind, np.zeros(encoder(tokenizer).size, np.int64)
        for batch in batches:
            for raws in runs(batch.column(0)):
                total += np.bincount(np.frombuffer(b"".join(raws.to_pylist()), kind), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    # At most as many rows as the vocabulary has.
    seen = docs.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    ordered = np.array([r.id for r in sorted(seen, key=lambda r: (-r.n, r.id))], np.uint32)
    rank_of = np.zeros(int(ordered.max(initial=0)) + 1, np.uint32)
    rank_of[ordered] = np.arange(len(ordered))
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/ranks.bin") as out:
        out.write(ordered.astype("<u4").tobytes())

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        context, kind = TaskContext.get(), encoder(tokenizer).kind
        shard, n_docs, n_ids = context.partitionId(), 0, 0
        temporary = f"{root}/.shard-{shard:06d}-{context.taskAttemptId()}"
        with store.open_output_stream(temporary) as out:
            for batch in batches:
                doc_ids, raws = batch.column(0).to_pylist(), batch.column(1)
                lengths = pc.binary_length(raws).to_numpy() // kind.itemsize
                ends, begin = np.cumsum(lengths), 0
                while begin < len(doc_ids):
                    before = int(ends[begin - 1]) if begin else 0
                    end = max(begin + 1, int(np.searchsorted(ends, before + BLOCK_IDS, side="right")))
                    values = np.frombuffer(b"".join(raws.slice(begin, end - begin).to_pylist()), kind)
                    out.write(block(doc_ids[begin:end], lengths[begin:end], rank_of[values]))
                    begin = end
                n_docs, n_ids = n_docs + len(doc_ids), n_ids + int(lengths.sum())
        store.move(temporary, f"{root}/shard-{shard:06d}")
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], names=["shard", "docs", "ids"])

    ordered_docs = docs.repartitionByRange(partitions(documents.sparkSession), "doc_id", "hash").sortWithinPartitions("doc_id", "hash").select("doc_id", "ids")
    done = ordered_docs.mapInArrow(save, "shard bigint, docs bigint, ids bigint").collect()
    return [(r.docs, r.ids) for r in sorted(done, key=lambda r: r.shard)]


def read(spark, path: str, shards: list[tuple[int, int]], crc: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and the ids of each document from the files, or with crc, instead of the ids, their crc32 as
    little-endian unsigned 32-bit integers."""
    starts = [0, *np.cumsum([n for _, n in shards]).tolist()]
    last = "ids_crc32" if crc else "ids"

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        with store.open_input_stream(f"{root}/ranks.bin") as stream:
            ids_of = np.frombuffer(stream.read(), "<u4")
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                start = starts[shard]
                with store.open_input_stream(f"{root}/shard-{shard:06d}") as stream:
                    for doc_ids, lengths, ranks in blocks(stream):
                        offset, ids = np.concatenate(([0], np.cumsum(lengths))), ids_of[ranks]
                        if crc:
                            raw = memoryview(ids).cast("B")
                            of = pa.array([zlib.crc32(raw[a:b]) for a, b in pairwise((4 * offset).tolist())], pa.int64())
                        else:
                            of = pa.ListArray.from_arrays(pa.array(offset, pa.int32()), pa.array(ids.astype(np.int32)))
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + offset[:-1]), pa.array(lengths), of], names=["doc_id", "start", "n_tokens", last])
                        start += int(offset[-1])

    schema = f"doc_id bigint, start bigint, n_tokens bigint, {last} {'bigint' if crc else 'array<int>'}"
    if not shards:
        return spark.createDataFrame([], schema)
    return spark.range(0, len(shards), 1, len(shards)).mapInArrow(load, schema)


def round_trip(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes all documents to fresh files in the shared folder and returns the digest of what is read back."""
    path = new_path(documents.sparkSession, "tokens")
    return read(documents.sparkSession, path, write(documents, path, tokenizer), crc=True)
