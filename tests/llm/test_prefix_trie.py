"""The prefix trie against a trie in dictionaries, with nulls, ties, repeated rows, long conversations and odd ids."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexmill.llm import prefix_trie, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, digest string, run int"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        base, h = c - int(c - 20 * int(c / 20)), zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = turns if base == c else own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out, children = [], defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, cs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(cs) - 1) * words
    for p, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(rebuilt[c]) == len(p))))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def built(spark, frame, tmp_path):
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.op13_prefix_trie(spark, str(tmp_path))
    return sorted(map(tuple, out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(8)
    out = [(c, t, draw.choice(["user", "assistant", None]), draw.choice(["hello there", "a b c", "", None, "x y z"]), 1, "x", 2) for c in range(-30, 70) for t in range(draw.randrange(1, 6))]
    out += [(c, t, "user", f"turn {t}", None, None, None) for c in (100, 101, 120, 200) for t in range(40)]
    out += [(200, 50, "user", "other", 1, "x", 2), (5, None, "user", "null first", 1, "x", 2), (5, None, "user", "and a tie", 1, "x", 2), (5, None, "user", "and a tie", 1, "x", 2), (None, 1, "user", "no id", 1, "x", 2)]
    out += [(c, 0, "user", "the same", 1, "x", 2) for c in range(1000, 1200)]
    return out


def test_all_prefixes(spark, rows, tmp_path):
    assert built(spark, spark.createDataFrame(rows, SCHEMA).repartition(7), tmp_path) == brute(rows)


def test_short_runs_slabs_and_pieces(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    monkeypatch.setattr(prefix_trie, "SLAB", 4)
    assert built(spark, spark.createDataFrame(rows, SCHEMA), tmp_path) == brute(rows)


def test_pieces_join_to_the_whole():
    import pyarrow as pa

    ids = [(bytes([d]), c) for d in range(3) for c in range(9000 * (d % 2) + 2)]
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in ids], pa.binary()), pa.array([c for _, c in ids], pa.int64())], names=["digest", "conv_id"])
    pieces = list(prefix_trie._pieces(iter([batch.slice(i, 700) for i in range(0, len(ids), 700)])))
    assert sum(p.num_rows for p in pieces) > 3
    found = {r["digest"]: r["ends_sha256"] for b in prefix_trie._ends(iter(pieces)) for r in b.to_pylist()}
    assert found == {bytes([d]): hashlib.sha256(",".join(str(c) for e, c in ids if e == bytes([d])).encode()).hexdigest() for d in range(3)}


def test_empty_and_deep(spark, tmp_path):
    assert built(spark, spark.createDataFrame([], SCHEMA), tmp_path / "none") == []
    deep = [(20, t, "user", f"t {t % 7}", 1, "x", 2) for t in range(1200)]
    assert built(spark, spark.createDataFrame(deep, SCHEMA), tmp_path / "deep") == brute(deep)
    turns = prefix_trie.numbered(spark.createDataFrame(deep, SCHEMA))
    assert turns.agg(F.max("n"), F.count_distinct("n")).first() == (1200, 1200)
