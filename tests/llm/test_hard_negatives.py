"""Hard negatives against loops over all pairs, with nulls, ties, repeated rows, odd vectors and huge numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import hard_negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int, row int, anchor string"


def brute(rows, positives=5, negatives=3):
    usable = [(i, v, label) for i, v, label, *_ in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a, (anchor_id, v, label) in enumerate(usable):
        if anchor_id is None or anchor_id % 50:
            continue
        scored = [(sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(v, w)), i, other) for b, (i, w, other) in enumerate(usable) if b != a]
        for p in sorted((s for s in scored if s[2] == label), key=order)[:positives]:
            inside = sorted((s for s in scored if s[2] != label and 50 * p[0] <= 100 * s[0] <= 95 * p[0]), key=order)[:negatives]
            out += [(anchor_id, p[1], k + 1, s[1], p[0], s[0]) for k, s in enumerate(inside)]
    return sorted(out, key=repr)


def found(rows, **options):
    return sorted(map(tuple, hard_negatives.mine(rows, anchor=F.col("vec_id") % 50 == 0, **options).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    out = [(i, [draw.choice([0.1, 0.2, 0.5, -0.3]) for _ in range(6)], draw.choice([1, 1, 2, 3]), 0, "x") for i in range(120)]
    out += [(50, out[50][1], out[50][2], 0, "x"), out[7], (None, out[3][1], 1, 0, "x")]
    out += [(200, None, 1, 0, "x"), (201, [0.1, None], 1, 0, "x"), (202, [float("nan")], 2, 0, "x"), (203, [float("inf")], 2, 0, "x"), (204, [0.1] * 6, None, None, None), (205, [0.9, 0.9], 2, 0, "x"), (206, [], 1, 0, "x")]
    return out


def test_all_pairs(spark, rows):
    assert brute(rows)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_many_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_CELLS", 6)
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(empty) == [] and hard_negatives.mine(empty, anchor=F.lit(True)).schema.simpleString() == "struct<anchor_id:bigint,positive_id:bigint,rank:int,negative_id:bigint,positive_score:bigint,negative_score:bigint>"
    assert found(spark.createDataFrame([(50, [0.1], 1, 0, "x"), (1, [0.1], None, 0, "x")], SCHEMA)) == []


def test_beyond_float64(spark):
    large = [(0, [3e9, 1.0], 1, 0, "x"), (1, [3e9, 0.5], 1, 0, "x"), (2, [2.7e9, 0.25], 2, 0, "x"), (3, [2.7e9, 0.5], 2, 0, "x"), (4, [2e9, 1.0], 3, 0, "x")]
    rows = [(i, [x / 256 for x in v], label, *rest) for i, v, label, *rest in large]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert hard_negatives.products(np.array([[1e200]]), np.array([[1e200], [-1e200], [1.0]])).tolist()[0][:2] == [(1 << 63) - 1, -(1 << 63) + 1]


def test_states_merge_to_the_whole():
    draw = np.random.default_rng(1)
    keys, scores, ids = draw.integers(0, 9, 500), draw.integers(0, 20, 500), draw.permutation(500)
    whole, parts = hard_negatives.Best(9, 4), hard_negatives.Best(9, 4)
    whole.update(keys, scores, ids, ids < 0)
    for at in np.array_split(np.arange(500), 11):
        parts.update(keys[at], scores[at], ids[at], ids[at] < 0)
    assert (whole.scores == parts.scores).all() and (whole.ids == parts.ids).all()
    for key in range(9):
        want = sorted((-s, i) for k, s, i in zip(keys, scores, ids) if k == key)[:4]
        assert want == list(zip(-whole.scores[key], whole.ids[key]))
