"""License scans against loops over every block, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from lexmill.llm import licenses

SCHEMA = "doc_id bigint, text string, label string, words int, pos int, token string"
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels, score = [], set(), 0.0
    for t in licenses.templates():
        g = len(t.words)
        if t.phrase:
            at = [p for p in range(len(words) - g + 1) if tuple(words[p : p + g]) == t.words]
            places += [(p, t.label) for p in at]
            score = max(score, 1.0 if at else 0.0)
        else:
            for p in range(0, len(words), g):
                share = len(set(t.words) & set(words[p : p + 2 * g])) / len(set(t.words))
                if share >= Fraction(4, 5):
                    labels.add(t.label)
                    score = max(score, share)
    base = {label for _, label in places}
    starts = [p for p, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score)


def texts():
    draw, known = random.Random(6), [" ".join(t.words) for t in licenses.templates()]
    out = [None, "", "...", "Under the MIT License", "cc by nc cc by-nc CC BY NC", "the mit license under", "underé the mit license", "under the mit licenſe", "cc by nc " * 300, "tarKet İ by nc \U0001f600cc by nc", "x" * 50_000]
    for text in known:
        out.append(text.title())
        words = text.split()
        for _ in range(6):
            part = [w for w in words if draw.random() < draw.choice([0.7, 0.8, 0.9])]
            if draw.random() < 0.3:
                draw.shuffle(part)
            filler = [draw.choice(["the", "of", "zz", "license", "software", "4", "nc"]) for _ in range(draw.randrange(30))]
            out.append(" ".join([*filler, *part, *filler]))
    return out


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "x", 1, 2, "nc") for i, t in enumerate(texts())]
    return [*out, out[4], out[4], (3, "another text of the same id", None, None, None, None), (None, "cc by nc", None, None, None, None), (None, "cc by nc", None, None, None, None)]


def test_every_block(spark, rows):
    found = defaultdict(list)
    for r in licenses.scan(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect():
        found[r.doc_id].append(tuple(r)[1:])
    want = defaultdict(list)
    for doc_id, text, *_ in rows:
        want[doc_id].append(brute(text))
    assert {k: sorted(v, key=repr) for k, v in found.items()} == {k: sorted(v, key=repr) for k, v in want.items()}
    labels = {x for v in want.values() for w in v for x in w[5].split(",") if x}
    assert labels == {t.label for t in licenses.templates()}


def test_empty_table_and_plan(spark, rows):
    frame = licenses.scan(spark.createDataFrame(rows[:3], SCHEMA))
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).collect() == []
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_rarest_words_first(spark):
    words = licenses._words(spark.createDataFrame([(1, "nc by by cc cc cc", "", 0, 0, "")], SCHEMA), "doc_id", "text")
    order = licenses.token_order(words, licenses.templates())
    assert [w for w in order if w in ("nc", "by", "cc")] == ["nc", "by", "cc"] and order[-1] == "cc"
    index = {(r.label, r.token) for r in licenses.prefix_index(words, licenses.templates(), order).collect()}
    assert ("cc-by-nc", "nc") in index and ("cc-by-nc", "by") not in index
