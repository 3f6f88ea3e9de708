"""Personal data by a semi-Markov conditional random field over whole spans.

Base spans come from four fixed patterns and always stay.  The field is run over tokens with a digit or an "@" alone, so what has
neither ("john at example dot com") is never scored.  There it scores candidate
segments of at most LONGEST tokens by features of the whole span (digits, Luhn sum, address parts, signs, the word before, a
base match of a kind), and a dynamic program chooses boundaries and types of a window jointly.  Segments that it labels and
that touch no base span are added.  The field is trained by its exact likelihood on seeded made-up windows: no document is
used.

Null texts count as empty; texts without digits or "@" have no spans; repeated rows get a row each; extra columns are
ignored.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexmill.llm.common import texts_of

KINDS = ("email", "ip", "card", "phone")
LONGEST = 8
#: The base patterns.
PATTERNS = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)
SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_TRIGGER = re.compile("[0-9@]")
_GAP = re.compile("[\x20\x09-\x0d]")
_CUES = tuple(re.compile(c) for c in (r"e-?mail|contact", r"\bip\b|host|server|address", r"card|visa|credit", r"phone|tel\b|call|mobile|fax"))


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _passes(kind: int, match: str) -> bool:
    if kind == 0:
        return True
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in match.split("."))
    digits = re.sub("[^0-9]", "", match)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The first pattern's matches, found from each "@" outwards: linear in the text, whatever runs it holds."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            after = domain.end()
            yield start, after
        else:
            after = at + 1
        at = text.find("@", after)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """The second pattern's matches: each four numbers in turn of a run of numbers joined by dots; linear in the text."""
    for run in _NUMBERS.finditer(text):
        dots = run[0].split(".")
        at = run.start()
        for i in range(0, len(dots) - 3, 4):
            size = sum(map(len, dots[i : i + 4])) + 3
            yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in order of kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)]
    if "." in text:
        out += [(1, a, b) for a, b in _addresses(text) if _passes(1, text[a:b])]
    for kind in (2, 3):
        out += [(kind, m.start(), m.end()) for m in PATTERNS[kind].finditer(text) if _passes(kind, m[0])]
    return out


def windows(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of neighbouring tokens that hold a digit or an "@", as (start, end)."""
    run: list[tuple[int, int]] = []
    at = 0
    while m := _TRIGGER.search(text, at):
        start = m.start()
        while start > at and not _GAP.match(text, start - 1):
            start -= 1
        gap = _GAP.search(text, m.end())
        end = gap.start() if gap else len(text)
        if run and text[run[-1][1] : start].strip("\x20\t\n\x0b\x0c\r"):
            yield run
            run = []
        run.append((start, end))
        at = end
    if run:
        yield run


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return start, end


def features(text: str, start: int, end: int, tokens: int, base: set[tuple[int, int, int]]) -> np.ndarray:
    s = text[start:end]
    digits = re.sub("[^0-9]", "", s)
    n = len(digits)
    parts = s.split(".")
    letters = any(c.isalpha() for c in s)
    before = text[max(0, start - 24) : start].lower()
    odd = re.sub(r"[A-Za-z0-9@.%_+\-\x20()]", "", s)
    return np.array(
        [
            1,
            n == 0,
            1 <= n < 7,
            7 <= n < 9,
            n == 9,
            10 <= n <= 12,
            13 <= n <= 15,
            16 <= n <= 19,
            n >= 20,
            s.count("@") == 1,
            "@" in s and "." in s.rpartition("@")[2],
            letters,
            len(parts) == 4 and all(re.fullmatch("[0-9]{1,3}", p) and int(p) <= 255 for p in parts),
            13 <= n <= 19 and not letters and luhn(digits),
            s.startswith("+"),
            "(" in s and ")" in s,
            not letters and "-" in s,
            "." in s,
            bool(odd),
            tokens == 1,
            tokens > 4,
            tokens - 1,
            bool(re.fullmatch(r"\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}", s)),
            *(bool(c.search(before)) for c in _CUES),
            *((k, start, end) in base for k in range(4)),
        ],
        float,
    )


def _lattice(text: str, run: list[tuple[int, int]], base: set[tuple[int, int, int]]) -> dict[tuple[int, int], tuple[int, int, np.ndarray]]:
    out = {}
    for i in range(len(run)):
        for j in range(i + 1, min(len(run), i + LONGEST) + 1):
            a, b = _trim(text, run[i][0], run[j - 1][1])
            if a < b:
                out[i, j] = a, b, features(text, a, b, j - i, base)
    return out


def decode(text: str, run: list[tuple[int, int]], weights: np.ndarray, base: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The best segmentation's entities; tokens outside of entities score 0.  Segments are scored as the dynamic program meets
    them, so memory holds a step for each token of the window."""
    best: list[tuple[float, tuple | None]] = [(0.0, None)]
    for j in range(1, len(run) + 1):
        choice = (best[j - 1][0], None)
        for i in range(max(0, j - LONGEST), j):
            a, b = _trim(text, run[i][0], run[j - 1][1])
            if a < b:
                scores = weights @ features(text, a, b, j - i, base)
                kind = int(scores.argmax())
                if best[i][0] + scores[kind] > choice[0]:
                    choice = best[i][0] + scores[kind], (i, kind, a, b)
        best.append(choice)
    out, j = [], len(run)
    while j:
        step = best[j][1]
        if step:
            out.append(step[1:])
        j = step[0] if step else j - 1
    return out[::-1]


def _examples(n: int, seed: int) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Made-up windows with their entities, and numbers of other kinds."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))

    def card() -> str:
        body = d(15)
        digits = next(body + c for c in "0123456789" if luhn(body + c))
        sign = rng.choice(["", " ", "-"])
        return sign.join(digits[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        plain = rng.choice(["{}-{}-{}", "({}) {}-{}", "{}.{}.{}"]).format(d(3), d(3), d(4))
        return rng.choice([f"+1 {plain}", f"+{d(2)} {d(3)} {d(3)} {d(3)}", f"+{d(11)}", plain])

    makers = (
        lambda: f"{word()}.{d(2)}@{word()}.{rng.choice(['com', 'org', 'example.com'])}",
        lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        card,
        phone,
    )
    others = (
        lambda: d(rng.randint(1, 6)),
        lambda: f"{d(1)},{d(3)}",
        lambda: f"{rng.randint(1900, 2030)}-{d(2)}-{d(2)}",
        lambda: f"{d(2)}:{d(2)}:{d(2)}",
        lambda: f"v{d(1)}.{d(2)}.{d(1)}",
        lambda: f"{d(1)}.{d(2)}",
        lambda: d(rng.randint(7, 20)),
        lambda: f"{rng.randint(256, 999)}.{d(3)}.{d(2)}.{d(3)}",
        lambda: f"@{word()}{d(2)}",
        lambda: hashlib.sha256(word().encode()).hexdigest()[: rng.choice([8, 32, 40])],
        lambda: f"{d(4)} {d(4)} {d(4)}",
        lambda: f"{d(3)}-{d(4)}",
    )
    cues = (("email", "contact"), ("ip", "server"), ("card", "visa"), ("phone", "call", "tel"))
    for _ in range(n):
        text, spans = f"{word()} ", []
        for _ in range(rng.randint(1, 3)):
            if rng.random() < 0.5:
                kind = rng.randrange(4)
                text += f"{rng.choice(cues[kind])}: " if rng.random() < 0.3 else ""
                s = makers[kind]()
                spans.append((kind, len(text), len(text) + len(s)))
            else:
                s = rng.choice(others)()
            text += s + rng.choice([" ", ", ", f" {word()} ", f". {word()} "])
        yield text, spans


@cache
def train(examples: int = 500, rounds: int = 30, seed: int = 3, rate: float = 0.5, ridge: float = 0.002) -> np.ndarray:
    """Weights (kind, feature) by gradient steps on the likelihood, with expectations by forward and backward sums."""
    data = []
    for text, spans in _examples(examples, seed):
        base = set(base_spans(text))
        for run in windows(text):
            lattice = _lattice(text, run, base)
            gold = {(k, a, b) for k, a, b in spans}
            truth = [(key, k) for key, (a, b, _) in lattice.items() for k in range(4) if (k, a, b) in gold]
            data.append((len(run), list(lattice), np.array([f for *_, f in lattice.values()]), truth))
    weights = np.zeros((4, len(data[0][2][0])))
    weights[:, 0] = -2
    square = np.full_like(weights, 1e-6)
    for _ in range(rounds):
        slope = ridge * weights * len(data)
        for n, keys, f, truth in data:
            score = f @ weights.T
            mass = np.logaddexp.reduce(score, axis=1)
            ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
            ahead[0] = behind[n] = 0
            for j in range(1, n + 1):
                ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[i] + mass[x] for x, (i, e) in enumerate(keys) if e == j)])
            for i in range(n - 1, -1, -1):
                behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[e] + mass[x] for x, (s, e) in enumerate(keys) if s == i)])
            inside = np.array([ahead[i] + behind[j] for i, j in keys]) - ahead[n]
            expected = np.exp(score + inside[:, None])
            for key, kind in truth:
                expected[keys.index(key), kind] -= 1
            slope += expected.T @ f
        square += slope * slope
        weights -= rate * slope / np.sqrt(square)
    return weights


def find(text: str | None, weights: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, each in order of kind and start."""
    if not text or not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    known = set(base)
    # Base spans by start, and the furthest end of those that start no later: what an added span would touch.
    order = sorted((a, e) for _, a, e in base)
    begins, reach = [a for a, _ in order], list(accumulate((e for _, e in order), max))
    added = []
    for run in windows(text):
        for kind, a, e in decode(text, run, weights, known):
            i = bisect_left(begins, e)
            if not i or reach[i - 1] <= a:
                added.append((kind, a, e))
    return base, sorted(known | set(added))


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def scan(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: counts and a digest of the base spans, and all spans."""
    weights = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t, weights) for t in texts_of(batch.column(1))]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
            digests = pa.array([hashlib.sha256(_said(base).encode()).hexdigest() for base, _ in found], pa.string())
            spans = pa.array([_said(every) for _, every in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *counts, digests, spans], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return documents.select(id_column, text_column).mapInArrow(run, SCHEMA)
