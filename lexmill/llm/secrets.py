"""Secret scans: all rules compiled into one minimised byte automaton that reads every text once.

The rules are compiled together twice: backwards for the pass over all bytes, which tells at every byte which rules have a match
that begins there, and forwards for the ends.  Of each rule the first beginning that is not inside the match before counts; from
there the forward automaton is followed through the match alone to its longest end.  So work is linear in the text, whatever
beginnings it holds, and a text is read rule by rule nowhere.

Base rules come out leftmost and without overlap for each kind, failing matches dropped.  Null texts count as empty and give no
spans; repeated rows give a row each; extra columns are ignored.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexmill.llm.automaton import SEPARATOR, Automaton, compile_rules
from lexmill.llm.common import give_back, texts_of
from lexmill.llm.shingles import slices

#: Fixed values: (kind, pattern, letters in either case, shortest match that counts).  The first three kinds are the base.
RULES: tuple[tuple[str, str, bool, int], ...] = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""", True, 0),
    ("access", r"AKIA[A-Z0-9]+", False, 20),
    ("hex", r"[0-9a-f]+", False, 24),
    ("github", r"gh[oprsu]_[A-Za-z0-9]+", False, 40),
    ("slack", r"xox[abprs]\-[A-Za-z0-9\-]+", False, 15),
    ("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", False, 40),
    ("pem", r"\-\-\-\-\-BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY\-\-\-\-\-", False, 0),
)
BASE = ("assign", "access", "hex")
SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


@cache
def automata() -> tuple[Automaton, Automaton]:
    """All rules backwards, and forwards; compiled once in each process."""
    rules = [(pattern, fold) for _, pattern, fold, _ in RULES]
    # Every byte of a hex run begins a match of the rule; backwards only those count that have enough bytes after them.
    enough = [(f"{pattern[:-1]}{{{least},}}" if kind == "hex" else pattern, fold) for kind, pattern, fold, least in RULES]
    return compile_rules(enough, backwards=True), compile_rules(rules)


def _passes(rule: int, match: bytes) -> bool:
    if RULES[rule][0] != "assign":
        return len(match) >= RULES[rule][3]
    mark = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    value = match[mark + 1 :].lstrip(b" ")
    return len(value) - (value[:1] in (b'"', b"'")) >= 6


def find(texts: Iterable[str | None]) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, rule, end) in order."""
    back, ahead = automata()
    out: list[list[tuple[int, int, int]]] = []
    for first, raws in slices(texts):
        out += [[] for _ in raws]
        whole = bytes([SEPARATOR]).join([*raws, b""])
        data = np.frombuffer(whole, np.uint8)
        at, bits = back.hits(data[::-1])
        starts, bits = len(data) - 1 - at[::-1], bits[::-1]
        ends = np.cumsum([len(r) + 1 for r in raws])
        found: dict[int, list[tuple[int, int, int]]] = {}
        for rule in range(len(RULES)):
            begins, i = starts[bits >> rule & 1 == 1], 0
            while i < len(begins):
                a = int(begins[i])
                b = ahead.longest(whole, a, rule)
                if _passes(rule, whole[a:b]):
                    found.setdefault(int(np.searchsorted(ends, a, side="right")), []).append((a, rule, b))
                i = int(np.searchsorted(begins, b))
        for k, spans in found.items():
            begin = int(ends[k]) - len(raws[k]) - 1
            points = np.concatenate(([0], np.cumsum((np.frombuffer(raws[k], np.uint8) & 0xC0) != 0x80)))
            out[first + k] = sorted((int(points[a - begin]), rule, int(points[b - begin])) for a, rule, b in spans)
    return out


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in spans)


def scan(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: the base counts, a digest of the base spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find(texts_of(batch.column(1)))
            base = [[s for s in spans if RULES[s[1]][0] in BASE] for spans in found]
            counts = [pa.array([sum(s[1] == k for s in spans) for spans in base], pa.int64()) for k in range(3)]
            digests = [hashlib.sha256(_said(spans).encode()).hexdigest() for spans in base]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *counts, pa.array(digests, pa.string()), pa.array(map(_said, found), pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
        give_back()

    return documents.select(id_column, text_column).mapInArrow(run, SCHEMA)
