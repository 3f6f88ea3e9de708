"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary text and one on windows of toxic text.  A window of WORDS
words is compressed with the ordinary dictionary alone and with the toxic one laid over it; the bytes that the second saves are
the window's distance, so what both kinds of text have counts for nothing.  As only few windows of a toxic text are toxic, the
toxic dictionary is trained in rounds, each smaller than the one before: those windows that the last round's dictionary shortens
most train the next.  Half of the toxic texts chooses the other half's windows, so no text is shortened by its own copy in a
dictionary, and windows that several texts hold word for word don't train it.  Nothing but compressed lengths chooses anything.
The thresholds on a document's distances (the largest, the mean, the share above a few bytes) are calibrated by logistic
regression on labelled documents that trained no dictionary; 0.5 rejects.

Bounds (only what is learnt from is bounded; scoring reads every whole text): SAMPLE labelled rows of each class in the order of
a hash of the id.  A third of them calibrates, whole texts of any length; the others train the dictionaries with texts of at most
LONGEST code points.  Null texts and texts without words get the score of a window without distance.  Repeated rows each get a
row; several labels of one id count as toxic if any is.  Without labelled rows of both classes every score is the share of toxic
ones (0 if there are none).  Only the text enters a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import fold, texts_of

SAMPLE, LONGEST = 2000, 20_000
WORDS, STEP, LEVEL = 6, 3, 3
#: Bytes of the ordinary dictionary, of the toxic one that all windows of a half train first, and of that of each round after.
ORDINARY_BYTES, SEED_BYTES, ROUNDS = 1 << 18, 1 << 18, (16384, 8192, 4096, 2048)
#: Windows of each toxic text that train the next round.
CHOSEN = 3
FEATURES = 7
#: Windows that are compressed at once.
BATCH = 4096


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    mean: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))
    constant: float | None = None

    def features(self, texts: list[str | None]) -> np.ndarray:
        return features(texts, compressor(self.ordinary), compressor(self.ordinary + self.toxic))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        x = (x - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -40, 40)))

    def calibrate(self, x: np.ndarray, labels: np.ndarray) -> None:
        """Ridge-penalised logistic regression by Newton's steps."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        x = np.column_stack(((x - self.mean) / self.scale, np.ones(len(x))))
        w = np.zeros(FEATURES + 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            w = w - np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.1 * np.eye(FEATURES + 1), x.T @ (p - labels) + 0.1 * w)
        self.weights = w


def compressor(content: bytes) -> zstd.ZstdCompressor:
    held = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    return zstd.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False)


def windows(text: str | None) -> list[bytes]:
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    return [b" " + b" ".join(words[j : j + WORDS]) + b" " for j in range(0, max(1, len(words) - WORDS + STEP), STEP)]


def lengths(with_: zstd.ZstdCompressor, pieces: list[bytes]) -> np.ndarray:
    return np.fromiter((len(with_.compress(w)) for w in pieces), np.int64, len(pieces))


def features(texts: list[str | None], plain: zstd.ZstdCompressor, both: zstd.ZstdCompressor) -> np.ndarray:
    out = np.empty((len(texts), FEATURES))
    for i, text in enumerate(texts):
        own = windows(text)
        d = np.sort(np.concatenate([lengths(plain, own[j : j + BATCH]) - lengths(both, own[j : j + BATCH]) for j in range(0, len(own), BATCH)]))[::-1]
        root = len(d) ** 0.5
        out[i] = d[0], d[:3].mean(), d[:6].mean(), d.mean(), (d >= 3).sum() / root, (d >= 5).sum() / root, math.log1p(len(d))
    return out


def _dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary trained on all samples; those that are too few to train one serve whole, as they are."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstd.train_dictionary(size, samples, d=8, k=segment).as_bytes()
    except (zstd.ZstdError, ValueError):
        return b"".join(samples)


def train(toxic: list[str], ordinary: list[str]) -> Model:
    """A model with both dictionaries, not calibrated yet."""
    rng = np.random.default_rng(7)

    def mixed(pieces: list[bytes]) -> list[bytes]:
        return [pieces[i] for i in rng.permutation(len(pieces))]

    base = _dictionary(mixed([w for t in ordinary for w in windows(t)[:: -(-WORDS // STEP)]]), ORDINARY_BYTES, 32)
    plain = compressor(base)
    halves = [[windows(t) for t in toxic[h::2]] for h in (0, 1)]
    without = [[lengths(plain, own) for own in half] for half in halves]
    learnt = [_dictionary(mixed([w for own in half for w in own[:: -(-WORDS // STEP)]]), SEED_BYTES, 12) for half in halves]
    best: list[list[bytes]] = [[], []]
    for size in ROUNDS:
        for h in (0, 1):
            other, count = compressor(base + learnt[1 - h]), Counter()
            for own, before in zip(halves[h], without[h], strict=True):
                count.update({own[i] for i in np.argsort(lengths(other, own) - before, kind="stable")[:CHOSEN]})
            best[h] = mixed(sorted(w for w, n in count.items() if n == 1)) or mixed(sorted(count))
        learnt = [_dictionary(b, size, 12) for b in best]
    return Model(base, _dictionary(best[0] + best[1], ROUNDS[-1], 12))


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """Learns from labelled rows outside the held-out fold.  The driver collects the bounded sample's texts, and of the rows that
    calibrate their features alone."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = documents.select("doc_id", "text").where(F.col("text").isNotNull()).withColumn("at", F.xxhash64(F.lit("toxicity"), "doc_id", "text"))
    # The sample is chosen by keys; only the texts that it holds are moved.
    keys = usable.select("doc_id", "at", (F.length("text") <= LONGEST).alias("short")).join(known, "doc_id")
    first, second = (keys.where(F.col("toxic") == toxic).orderBy("at", "doc_id").limit(SAMPLE) for toxic in (1, 0))
    rows = sorted(first.union(second).collect(), key=lambda r: (r.toxic, r.at, r.doc_id))  # at most 2 * SAMPLE rows
    apart = [r for i, r in enumerate(rows) if i % 3 == 0]
    rest = [r for i, r in enumerate(rows) if i % 3 and r.short]
    spark = documents.sparkSession

    def those(picked: list) -> DataFrame:
        held = spark.createDataFrame([(r.doc_id, r.at, int(r.toxic)) for r in picked], "doc_id long, at long, toxic int").distinct()
        return usable.join(F.broadcast(held), ["doc_id", "at"]).dropDuplicates(["doc_id", "at"])

    both = {r.toxic for r in apart}, {r.toxic for r in rest}
    if both != ({0, 1}, {0, 1}):
        return Model(constant=sum(r.toxic for r in rows) / len(rows) if rows else 0.0)
    texts = sorted(those(rest).collect(), key=lambda r: (r.toxic, r.at, r.doc_id))
    model = train([r.text for r in texts if r.toxic == 1], [r.text for r in texts if r.toxic == 0])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.features(list(texts_of(batch.column(0))))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["toxic", "x"])

    seen = sorted(those(apart).select("text", "toxic").mapInArrow(measured, "toxic int, x array<double>").collect())
    model.calibrate(np.array([r.x for r in seen]), np.array([r.toxic for r in seen]))
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(model.features(list(texts_of(batch.column(2)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return documents.select(F.col("doc_id").cast("bigint"), (fold() == 0).alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_clean(documents: DataFrame, model: Model) -> DataFrame:
    """The rows that are not rejected, with all their columns as they were."""

    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(model.features(list(texts_of(batch.column(at))))) < 0.5))

    return documents.mapInArrow(run, documents.schema)
