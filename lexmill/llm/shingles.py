"""Vectorised text hashing: whole Arrow batches of texts to word, word-shingle and character-shingle hashes.

All hashes are 64-bit and depend only on the bytes of the text, never on the batch that a text arrives in, so every
executor computes the same value.  Work is done on slices of about ``SLICE`` bytes, which bounds memory whatever the
batch; a single longer text makes a longer slice.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SLICE = 1 << 18
#: An odd base of the polynomial byte hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        tables = []
        for base in (BASE, _INVERSE):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _powers = tables[0], tables[1]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def slices(texts: Iterable[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about SLICE bytes, with the index of each run's first text; null counts as empty."""
    start, size, out = 0, 0, []
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if out and size + len(raw) > SLICE:
            yield start, out
            start, size, out = i, 0, []
        out.append(raw)
        size += len(raw) + 1
    if out:
        yield start, out


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """c with c[j]-c[i] = sum of (byte+1)*BASE**k over k in [i,j), modulo 2**64."""
    power, _ = _power_tables(len(raw) + 1)
    c = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=c[1:])
    return c


def substring_hashes(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = _power_tables(len(c))
    return mix((c[end] - c[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of bytes other than space and 9 to 13) of each text in turn, and where each text's begin."""
    buffer = np.frombuffer(b" ".join([*raws, b""]), np.uint8)
    black = (buffer != 32) & ((buffer < 9) | (buffer > 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], black, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    hashed = substring_hashes(prefix_sums(buffer), start, end) if len(start) else np.zeros(0, np.uint64)
    bounds = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raws])))
    return hashed, np.searchsorted(start, bounds)


def word_shingles(raws: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each text in turn (a text of 1 to k-1 words has one, of all its words), and each text's first."""
    word, first = word_hashes(raws)
    n = np.diff(first)
    if len(word) >= k:
        rolled = np.zeros(len(word) - k + 1, np.uint64)
        for j in range(k):
            rolled = rolled * np.uint64(BASE) + word[j : len(word) - k + 1 + j]
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, np.uint64)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros(at[-1], np.uint64)
    full = np.repeat(n >= k, count)
    source = np.arange(at[-1]) - np.repeat(at[:-1], count) + np.repeat(first[:-1], count)
    out[full] = rolled[source[full]]
    for i in np.flatnonzero((n > 0) & (n < k)):
        total = 0
        for x in word[first[i] : first[i + 1]].tolist():
            total = (total * BASE + x) & 0xFFFFFFFFFFFFFFFF
        out[at[i]] = mix(np.array([total + int(n[i])], np.uint64))[0] if total + int(n[i]) < 1 << 64 else mix(np.array([total], np.uint64))[0]
    return out, at


def multipliers(n: int, seed: int) -> np.ndarray:
    """n pairs (odd factor, addend) of 32-bit hash functions, from the seed."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.integers(0, 1 << 32, n, np.uint64) | np.uint64(1), rng.integers(0, 1 << 32, n, np.uint64)], 1).astype(np.uint32)


def minhash(shingles: np.ndarray, at: np.ndarray, functions: np.ndarray) -> np.ndarray:
    """One row of len(functions) 32-bit minima for each text with shingles; the caller drops texts without any."""
    low = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    out = np.empty((len(at) - 1, len(functions)), np.uint32)
    x = np.empty_like(low)
    for j, (factor, addend) in enumerate(functions):
        np.multiply(low, factor, out=x)
        np.add(x, addend, out=x)
        np.bitwise_xor(x, x >> np.uint32(15), out=x)
        np.multiply(x, np.uint32(0x2C1B3C6D), out=x)
        out[:, j] = np.minimum.reduceat(x, at[:-1])
    return out


def _rolled(x: np.ndarray, k: int) -> np.ndarray:
    """Sums of x[i + j] * BASE**j over j < k for each i, modulo 2**64, by doubling."""
    out, offset, block, size, base = None, 0, x, 1, BASE
    while k:
        if k & 1:
            if out is None:
                out = block
            else:
                more = block[offset:] * np.uint64(pow(BASE, offset, 1 << 64))
                out = out[: len(more)] + more
            offset += size
        k >>= 1
        if k:
            block = block[:-size] + block[size:] * np.uint64(base)
            size, base = 2 * size, base * base & 0xFFFFFFFFFFFFFFFF
    return out


def char_shingles(lines: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of k code points of each line in turn (a line of 1 to k-1 has one, the whole line; an empty line
    none), and each line's first."""
    points = np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    first = np.concatenate(([0], np.cumsum(n + 1)))[:-1]
    at = np.concatenate(([0], np.cumsum(np.where(n >= k, n - k + 1, np.minimum(n, 1)))))
    out = np.empty(at[-1], np.uint64)
    full = np.repeat(n >= k, np.diff(at))
    if full.any():
        out[full] = _rolled(points, k)[(np.arange(at[-1]) + np.repeat(first - at[:-1], np.diff(at)))[full]]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = n[short].astype(np.uint64)
        for j in range(k - 1):
            inside = n[short] > j
            whole[inside] += points[first[short][inside] + j] * np.uint64(pow(BASE, j + 1, 1 << 64))
        out[at[short]] = whole
    return mix(out), at


def one_permutation(shingles: np.ndarray, at: np.ndarray, bins: int, seed: int) -> np.ndarray:
    """One-permutation MinHash with densification: a row of `bins` 32-bit minima for each item (each has a shingle).

    A shingle falls in one bin by its upper half; an empty bin takes the value of the first filled one in a sequence of
    bins that depends on the empty bin alone, so that two items agree there as often as elsewhere.
    """
    items = len(at) - 1
    h = mix(shingles ^ np.uint64(seed))
    cell = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    cell += np.repeat(np.arange(items) * bins, np.diff(at))
    empty = np.uint32(0xFFFFFFFF)
    out = np.full(items * bins, empty, np.uint32)
    np.minimum.at(out, cell, h.astype(np.uint32) & np.uint32(0x7FFFFFFF))
    todo = np.flatnonzero(out == empty)
    filled = out.copy()
    tried = 0
    while len(todo):
        bin_, row = todo % bins, todo // bins
        tried += 1
        other = (mix(bin_.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(tried)) % np.uint64(bins)).astype(np.int64)
        value = filled[row * bins + other]
        found = value != empty
        out[todo[found]] = value[found]
        todo = todo[~found]
    return out.reshape(items, bins)
