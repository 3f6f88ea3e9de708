"""LM scoring with a gated recurrent network in numpy.

Training counts all tokens of the training fold in Spark.  The network knows the VOCABULARY commonest words and a tail
token; a tail word's probability is the tail token's times its share of the tail by smoothed counts, so probabilities of all
V + 1 outcomes sum to one.  The output is factored into classes of equally many words.  Each of ROUNDS passes trains a copy of
the network on every partition's whole training texts by truncated backpropagation (windows of WINDOW steps, state carried
on) and averages the copies by their tokens, in a tree of sums.  Scoring carries the state through each whole document, many
documents side by side.  Texts become numbers once; rounds and scoring read the numbers.

Tokens: ASCII-lower-cased runs of bytes other than space and 9 to 13, then one end.  Null texts are empty (the end alone);
repeated rows get a row each; extra columns are ignored; without training rows every probability is uniform over what is
known.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import fold, stored, texts_of
from lexmill.llm.shingles import slices, word_hashes

HIDDEN, VOCABULARY, CLASSES, WINDOW, ROUNDS, RATE = 16, 2048, 64, 32, 2, 0.05
#: Words whose counts every worker holds; the counts of rarer ones are joined.
HEAD = 1 << 16
TRAIN_LANES, SCORE_LANES = 64, 512
#: Classes of at most so many rows of a window are padded to one product; above the last a class has a product of its own.
CROWDED = (24, 96)
#: First bits of a hash by which it is looked up.
BITS = 18
#: Rows whose classes are told at once.
PIECE = 2048
#: Tokens that are dealt to lanes at once (one document may be longer).
GROUP = 1 << 22
END = np.uint64(0x656E64)
WIDTH = VOCABULARY // CLASSES
SHAPES = {"x": (VOCABULARY, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "c": (CLASSES, HIDDEN + 1), "w": (VOCABULARY, HIDDEN + 1)}  # with biases last
LN10 = float(np.log(10.0))


@dataclass
class Words:
    """Head words by hash: vocabulary number (VOCABULARY - 1: tail) and log10(count + 0.5), and the totals."""

    hashes: np.ndarray
    number: np.ndarray
    logs: np.ndarray
    tokens: int
    distinct: int
    tail_mass: float
    end: int


def token_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts with an end after each, and each text's first."""
    hashed, first = word_hashes([r.lower() for r in raws])
    return np.insert(hashed, first[1:], END), first + np.arange(len(first))


def count_words(training: DataFrame) -> DataFrame:
    """(hash, n) of the tokens of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [token_hashes(raws)[0] for _, raws in slices(texts_of(batch.column(0)))]
            h, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["hash", "n"])

    return training.select("text").mapInArrow(run, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))


def words_of(counts: DataFrame) -> tuple[Words, np.ndarray]:
    """The head words and the counts of the vocabulary's."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # Every task sends only what belongs to the head: all words above a step of counts, and of that step a share by hash.
    step = F.floor(F.log2(F.col("n").cast("double")) * 8)
    room, low, share = HEAD, 0, 0.0
    for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect():
        low, share = r.step, min(1.0, room / r.words)
        room -= r.words
        if room <= 0:
            break
    kept = (step > low) | ((step == low) & (F.pmod(F.xxhash64("hash"), F.lit(1 << 20)) < int(share * (1 << 20))))
    rows = sorted(counts.where(kept).collect(), key=lambda r: (-r.n, r.hash))
    h = np.array([r.hash for r in rows], np.int64).view(np.uint64)
    n = np.array([r.n for r in rows], np.int64)
    if END not in h:
        known = counts.where(F.col("hash") == int(END)).collect()
        h, n = np.append(h, END), np.append(n, known[0].n if known else 0)
    at = int(np.flatnonzero(h == END)[0])
    order = np.concatenate(([at], np.delete(np.arange(len(h)), at)))  # the end is word 0
    h, n = h[order], n[order]
    number = np.minimum(np.arange(len(h)), VOCABULARY - 1)
    inside = n[: VOCABULARY - 1]
    seen = int((inside > 0).sum())
    mass = total - int(inside.sum()) + 0.5 * (distinct - seen) + 0.5
    by_hash = np.argsort(h)
    return Words(h[by_hash], number[by_hash], np.log10(n[by_hash] + 0.5), total, distinct, mass, 0), np.append(inside.astype(float), mass)


def initial(counts: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Small random weights, and biases that give the smoothed counts' distribution."""
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in SHAPES.items()}
    share = np.full(VOCABULARY, 1e-9)
    share[: len(counts) - 1] = counts[:-1] + 0.5
    share[VOCABULARY - 1] = counts[-1]
    of_class = share.reshape(CLASSES, WIDTH).sum(1)
    p["w"] *= 0
    p["c"] *= 0
    p["w"][:, HIDDEN] = np.log(share / np.repeat(of_class, WIDTH))
    p["c"][:, HIDDEN] = np.log(of_class / of_class.sum())
    return p


@dataclass
class Lanes:
    """Documents end to end in lanes, and the lanes end to end: memory follows the tokens, however long one document is."""

    target: np.ndarray
    number: np.ndarray  # the document of each token
    begins: np.ndarray
    first: np.ndarray  # of each lane, the longest lane first
    length: np.ndarray


def lanes(docs: list[np.ndarray], most: int) -> Lanes:
    k = max(1, min(most, len(docs)))
    size = np.array([len(d) for d in docs])
    heap, own = [(0, i) for i in range(k)], [[] for _ in range(k)]
    for d in np.argsort(-size, kind="stable").tolist():
        total, i = heapq.heappop(heap)
        own[i].append(d)
        heapq.heappush(heap, (total + int(size[d]), i))
    length = np.array([size[ds].sum() for ds in own])
    by = np.argsort(-length, kind="stable")
    order = np.concatenate([own[i] for i in by.tolist()])
    length = length[by]
    begins = np.zeros(size.sum(), bool)
    begins[np.cumsum(size[order]) - size[order]] = True
    return Lanes(np.concatenate([docs[d] for d in order.tolist()]), np.repeat(order, size[order]), begins, np.cumsum(length) - length, length)


def _softmax(s: np.ndarray, w: np.ndarray, pick: np.ndarray, slope: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Log-likelihoods of the picks after states s (a row each) by weights w, and with slope those by s and by w."""
    e = s @ w.swapaxes(-1, -2)
    np.exp(e, out=e)
    ones = np.ones(e.shape[-1], np.float32)
    total, at = e @ ones, np.arange(pick.size) * e.shape[-1] + pick.ravel()
    own = e.take(at).reshape(total.shape)
    if not (own.min() > 1e-34 and total.max() < 1e34):  # seldom: too large for exp
        e = np.exp(np.clip(s @ w.swapaxes(-1, -2), -80, 80))
        total, own = e @ ones, e.take(at).reshape(total.shape)
    logp = np.log(own / total)
    if not slope:
        return logp, None, None
    e.reshape(-1)[at] = (own - total).ravel()
    share = (1 / total)[..., None]
    return logp, (e @ w[..., :HIDDEN]) * share, e.swapaxes(-1, -2) @ (s * share)


def _output(p: dict[str, np.ndarray], s: np.ndarray, y: np.ndarray, slopes: dict[str, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-likelihoods of words y after states s (a row each, then a one), and slopes by s; the other slopes go to `slopes`, if wanted.

    The words inside a class: classes with many words one by one, all others side by side in padded products."""
    slope, m = slopes is not None, len(y)
    order = np.argsort(y.astype(np.int16), kind="stable")
    s, y = np.concatenate((s.take(order, axis=0), np.zeros((1, HIDDEN + 1), np.float32))), y.take(order)  # the last row is padding
    c = y // WIDTH
    inner, weights = y - c * WIDTH, p["w"].reshape(CLASSES, WIDTH, HIDDEN + 1)
    logp, within = np.empty(m, np.float32), np.empty(m + 1, np.float32)
    ds = by_word = None
    if slope:
        slopes["c"], slopes["w"] = np.zeros_like(p["c"]), np.zeros_like(p["w"])
        ds, by_word = np.empty((m, HIDDEN), np.float32), np.empty((m + 1, HIDDEN), np.float32)
        of_class = slopes["w"].reshape(weights.shape)
    for start in range(0, m, PIECE):
        at = slice(start, min(start + PIECE, m))
        logp[at], x, w = _softmax(s[at], p["c"], c[at], slope)
        if slope:
            ds[at] = x
            slopes["c"] += w
    edge = np.searchsorted(c, np.arange(CLASSES + 1))
    count = np.diff(edge)
    for k in np.flatnonzero(count > CROWDED[-1]).tolist():
        at = slice(edge[k], edge[k + 1])
        within[at], x, w = _softmax(s[at], weights[k], inner[at], slope)
        if slope:
            by_word[at], of_class[k] = x, w
    for low, high in zip((0, *CROWDED[:-1]), CROWDED, strict=True):
        few = np.flatnonzero((count > low) & (count <= high))
        if len(few):
            place = np.arange(count[few].max())
            at = np.where(place < count[few, None], edge[few, None] + place, m)
            within[at], x, w = _softmax(s.take(at, axis=0), weights[few], np.append(inner, 0)[at], slope)
            if slope:
                by_word[at], of_class[few] = x, w
    logp += within[:m]
    back = np.empty_like(order)
    back[order] = np.arange(m)
    return logp.take(back), (ds + by_word[:m]).take(back, axis=0) if slope else None


def run(p: dict[str, np.ndarray], docs: list[np.ndarray], most: int, square: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """Natural log-likelihood of each document; with square (sums of squared slopes, above 0) it also trains p, window by window.

    Arrays of a window are (step, feature, lane), those of the output have a row for each token."""
    dealt = lanes(docs, most)
    logs = np.zeros(len(dealt.target), np.float32)
    state = np.zeros((HIDDEN, len(dealt.first)), np.float32)
    steps = np.arange(WINDOW)[:, None]
    two = 2 * HIDDEN
    scale, one = np.repeat(np.array([-1, -1, 1], np.float32), HIDDEN)[:, None], np.float32(1)  # a logistic is 1 / (1 + exp(-x))
    with np.errstate(over="ignore"):
        for start in range(0, int(dealt.length[0]), WINDOW):
            n = int(np.searchsorted(-dealt.length, -start))  # lanes that go on
            left = dealt.length[:n] - start
            depth = min(WINDOW, int(left[0]))
            inside = steps[:depth] < left
            at = dealt.first[:n] + start + np.minimum(steps[:depth], left - 1)
            begin = dealt.begins.take(at)
            source = np.where(begin, 0, dealt.target.take(np.maximum(at - 1, 0)))  # a document starts after an end
            keep, fresh = (~begin).astype(np.float32), begin.any(1).tolist()
            slopes: dict[str, np.ndarray] | None = None if square is None else {}
            # Forward: gates (update, reset), the candidate's part by the state, the candidate, and the state of each step.
            x, u = np.empty((depth, 3 * HIDDEN, n), np.float32), np.ascontiguousarray(p["u"].T * scale)
            np.multiply(p["x"].take(source, axis=0).transpose(0, 2, 1), scale, out=x)
            kept = 1 if slopes is None else depth  # steps whose parts the slopes need
            into, gates, new = (np.empty((kept, k, n), np.float32) for k in (3 * HIDDEN, two, HIDDEN))
            states = np.empty((depth + 1, HIDDEN, n), np.float32)
            states[0] = state[:, :n]
            parts = [list(v) for v in (into, into[:, :two], into[:, two:], gates, gates[:, :HIDDEN], gates[:, HIDDEN:], new)]
            before = states[0]
            for t, (of_gates, of_new, now) in enumerate(zip(x[:, :two], x[:, two:], states[1:], strict=True)):
                i, i_gates, i_new, g, update, reset, c = (v[t % kept] for v in parts)
                if fresh[t]:
                    before = before * keep[t]
                np.dot(u, before, out=i)
                np.add(of_gates, i_gates, out=g)
                np.exp(g, out=g)
                np.add(g, one, out=g)
                np.reciprocal(g, out=g)
                np.multiply(reset, i_new, out=c)
                np.add(c, of_new, out=c)
                np.tanh(c, out=c)
                np.subtract(before, c, out=now)
                np.multiply(now, update, out=now)
                np.add(now, c, out=now)
                before = now
            state[:, :n] = states[depth]
            # All columns in one order, and those past a lane's end left out.
            rows = np.ones((depth, n, HIDDEN + 1), np.float32)
            rows[:, :, :HIDDEN] = states[1:].transpose(0, 2, 1)
            rows = rows.reshape(-1, HIDDEN + 1)
            whole = bool(inside.all())
            live = slice(None) if whole else np.flatnonzero(inside.ravel())
            flat = at.ravel()[live]
            logs[flat], out = _output(p, rows[live], dealt.target.take(flat), slopes)
            if slopes is None:
                continue
            if not whole:
                out, part = np.zeros((depth * n, HIDDEN), np.float32), out
                out[live] = part
            ds = np.ascontiguousarray(out.reshape(depth, n, HIDDEN).transpose(0, 2, 1))
            before = states[:-1] * keep[:, None]
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            by_state, by_new = np.empty((2, depth, 2, HIDDEN, n), np.float32)  # of update and candidate; of the state's part and reset
            stay = 1 - z
            np.multiply(before - new, z * stay, out=by_state[:, 0])
            np.multiply(stay, 1 - new * new, out=by_state[:, 1])
            by_new[:, 0] = r
            np.multiply(into[:, two:], r - r * r, out=by_new[:, 1])
            # Slopes by the candidate's part by the state, update, reset and candidate.
            du, after = np.empty((depth, 4, HIDDEN, n), np.float32), np.zeros((HIDDEN, n), np.float32)
            back = np.concatenate((p["u"][:, two:], p["u"][:, :two]), axis=1)
            to_u = du.reshape(depth, 4 * HIDDEN, n)[:, : 3 * HIDDEN]
            for t, dh, d, d_u, of_state, of_new, update in zip(range(depth - 1, -1, -1), ds[::-1], du[::-1], to_u[::-1], by_state[::-1], by_new[::-1], z[::-1], strict=True):
                np.add(dh, after, out=dh)
                np.multiply(dh, of_state, out=d[1::2])
                np.multiply(d[3], of_new, out=d[::2])
                np.dot(back, d_u, out=after)
                np.multiply(dh, update, out=dh)
                np.add(after, dh, out=after)
                if fresh[t]:
                    after *= keep[t]
            du = np.ascontiguousarray(du.reshape(depth, 4 * HIDDEN, n).transpose(0, 2, 1)).reshape(-1, 4 * HIDDEN)
            by_u = before.transpose(1, 0, 2).reshape(HIDDEN, -1) @ du[:, : 3 * HIDDEN]
            slopes["u"] = np.concatenate((by_u[:, HIDDEN:], by_u[:, :HIDDEN]), axis=1)
            word = source.ravel()
            by = np.argsort(word.astype(np.int16), kind="stable")
            edge = np.flatnonzero(np.diff(word.take(by), prepend=-1))
            touched = word.take(by.take(edge))
            ranked = du.take(by, axis=0)[:, HIDDEN:]
            slopes["x"] = np.add.reduceat(ranked[: edge[-1] + 1], edge, axis=0)
            slopes["x"][-1] = ranked[edge[-1] :].sum(0)  # the tail's rows are most
            for k, g in slopes.items():
                np.clip(g, -50, 50, out=g)
                root = g * g
                if k == "x":  # words that don't occur have no slope
                    root += square[k].take(touched, axis=0)
                    square[k][touched] = root
                    np.sqrt(root, out=root)
                else:
                    square[k] += root
                    np.sqrt(square[k], out=root)
                g /= root
                g *= RATE
                if k == "x":
                    p[k][touched] -= g
                else:
                    p[k] -= g
    return np.bincount(dealt.number, weights=logs, minlength=len(docs))


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def _unflat(v: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[k] = v[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return out


def _places(words: Words) -> np.ndarray:
    """Of each value of a hash's first BITS bits, the first place in the head that is not below it."""
    return np.searchsorted(words.hashes, np.arange(1 << BITS, dtype=np.uint64) << np.uint64(64 - BITS))


def _numbers(words: Words, places: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in the head (its length where absent) and vocabulary number of each token."""
    at = places.take((hashed >> np.uint64(64 - BITS)).view(np.int64))
    last = len(words.hashes)
    hashes = np.append(words.hashes, np.uint64((1 << 64) - 1))
    below = np.flatnonzero(hashes.take(at) < hashed)
    while len(below):  # hashes spread evenly, so few share their first bits
        at[below] += 1
        below = below[hashes.take(at[below]) < hashed[below]]
    at[hashes.take(at) != hashed] = last
    return at, np.append(words.number, VOCABULARY - 1).take(at)


def code(docs: DataFrame, words: Words) -> DataFrame:
    """Of each row its other columns, n_tokens, n_known, base (logarithms of the head's counts), tail (the same of the tail's over
    its mass), rare (hashes outside the head) and numbers (the tokens' vocabulary numbers, 16 bits each)."""
    others = [f for f in docs.schema.fields if f.name != "text"]
    names = [*(f.name for f in others), "n_tokens", "n_known", "base", "tail", "rare", "numbers"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, in_tail = np.append(words.logs, 0.0), np.append(words.number == VOCABULARY - 1, False)
        known, log_mass = np.append(words.logs > np.log10(0.5), False), float(np.log10(words.tail_mass))
        places = _places(words)
        for batch in batches:
            parts, rare, numbers, lengths = [[], [], []], [], [], []
            for _, raws in slices(texts_of(batch.column(len(others)))):
                hashed, first = token_hashes(raws)
                at, number = _numbers(words, places, hashed)
                bounds, number = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)), number.astype(np.int16)
                numbers += [number[a:b].tobytes() for a, b in bounds]
                for out, x in zip(parts, (known[at], logs[at], np.where(in_tail[at], logs[at] - log_mass, 0.0)), strict=True):
                    out.append(np.add.reduceat(x.astype(float), first[:-1]))
                absent = at == len(words.hashes)
                rare += [hashed[a:b][absent[a:b]].view(np.int64) for a, b in bounds]
                lengths += np.diff(first).tolist()
            if not lengths:
                continue
            sums = [np.concatenate(x) for x in parts]
            offset = np.concatenate(([0], np.cumsum([len(r) for r in rare])))
            rest = pa.ListArray.from_arrays(pa.array(offset, pa.int32()), pa.array(np.concatenate(rare)))
            own = [pa.array(lengths, pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), rest, pa.array(numbers, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *own], names=names)

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in others) + "n_tokens bigint, n_known bigint, base double, tail double, rare array<bigint>, numbers binary"
    return docs.select(*(f.name for f in others), "text").mapInArrow(each, schema)


def _groups(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """Documents of a column of numbers, about GROUP tokens at a time."""
    docs, size = [], 0
    for raw in texts_of(column):
        docs.append(np.frombuffer(raw, np.int16))
        size += len(docs[-1])
        if size >= GROUP:
            yield docs
            docs, size = [], 0
    if docs:
        yield docs


def train(training: DataFrame, words: Words, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Averages of copies that are trained on every partition's texts."""
    return fit(stored(code(training.select("text"), words).select("numbers"), "lm-coded"), counts)


def fit(coded: DataFrame, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Averages of copies that are trained on every partition's numbers."""
    p = initial(counts)
    for _ in range(ROUNDS):
        begin = _flat(p)

        def each(batches: Iterator[pa.RecordBatch], begin: np.ndarray = begin) -> Iterator[pa.RecordBatch]:
            own, tokens = _unflat(begin), 0
            square = {k: np.full_like(v, 1e-3) for k, v in own.items()}
            for batch in batches:
                for docs in _groups(batch.column(0)):
                    run(own, docs, TRAIN_LANES, square)
                    tokens += sum(map(len, docs))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array([float(tokens)]), pa.array([(_flat(own).astype(np.float64) * tokens).tobytes()], pa.binary())], names=["weight", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight, sums = 0.0, 0
            for batch in batches:
                for w, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    weight, sums = weight + w, sums + np.frombuffer(s)
            if weight:
                yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([sums.tobytes()], pa.binary())], names=["weight", "sums"])

        copies = stored(coded.select("numbers").mapInArrow(each, "weight double, sums binary"), "lm-copies")
        while (n := copies.count()) > 16:
            copies = stored(copies.repartition(-(-n // 16)).mapInArrow(add, "weight double, sums binary"), "lm-copies")
        rows = copies.collect()
        if rows:
            p = _unflat(sum(np.frombuffer(r.sums) for r in rows) / sum(r.weight for r in rows))
    return p


def score(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", (fold() == 1).alias("held_out"))
    counts = stored(count_words(docs.where(~F.col("held_out"))), "lm-counts")
    words, vocabulary = words_of(counts)
    coded = stored(code(docs, words).withColumn("row", F.monotonically_increasing_id()), "lm-coded")
    weights = _flat(fit(coded.where(~F.col("held_out")), vocabulary))
    log_mass = float(np.log10(words.tail_mass))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _unflat(weights)
        for batch in batches:
            likely = [run(p, group, SCORE_LANES) for group in _groups(batch.column(0))]
            if likely:
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(likely) / LN10)], names=[*batch.schema.names[1:], "likely"])

    schema = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, tail double, likely double"
    kept = ("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "tail")
    rows = stored(coded.select("numbers", *kept).mapInArrow(each, schema), "lm-rows")
    # Rare words' counts: each occurrence goes to its word's count and back to its document's sums.
    met = coded.select("row", F.explode("rare").alias("hash")).join(counts, "hash", "left")
    extra = met.groupBy("row").agg(F.count("n").alias("also"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("logs"), F.count(F.lit(1)).alias("m"))
    out = rows.join(extra, "row", "left")
    logs, m = F.coalesce("logs", F.lit(0.0)), F.coalesce("m", F.lit(0))
    norm = float(np.log10(words.tokens + 0.5 * (words.distinct + 1)))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(words.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("likely") + F.col("tail") + logs - m * log_mass).alias("score"),
    )
