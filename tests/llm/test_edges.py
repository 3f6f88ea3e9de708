"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns for every operator, and brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexmill.llm import decontaminate, fingerprints, line_dedup, mixing, ngram_join, pii, rnn_lm, secrets, token_output, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, item string, n int, `row` int"
LONG = " ".join(f"word{i % 997}" for i in range(6000))
NEAR = [f"alpha{i}" for i in range(40)]
ROWS = [
    (1, "one two three four five six seven\npassword = hunter2hunter2 and +1 (743) 555-3824\nshared line of text that is long", "en", "a", 1, "x", 1, 1),
    (1, "one two three four five six seven\npassword = hunter2hunter2 and +1 (743) 555-3824\nshared line of text that is long", "en", "a", 1, "x", 1, 1),
    (2, None, None, None, None, None, None, None),
    (3, "", "en", "b", 0, "x", 1, 1),
    (None, "no id here\nshared line of text that is long!", "en", None, 5, "y", 2, 2),
    (4, LONG, "en", "c", len(LONG), "y", 2, 2),
    (5, " ".join(NEAR), "en", "c", 9, "y", 2, 2),
    (6, " ".join([*NEAR[:-1], "other"]), "en", "c", 9, "y", 2, 2),
    (7, "Émile's mail is re.46@mail8.example.com and 10.0.0.1 ok", "fr", "c", 9, "y", 2, 2),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 1), (None, None, None)], "doc_id bigint, quality int, toxic int")


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(r)
    return out


def test_lines(docs):
    rows = by_id(line_dedup.report(docs))
    assert len(rows[1]) == 2 and rows[2][0].n_lines == 0 and rows[3][0].n_kept == 0
    assert rows[None][0].removed_lines == [] and rows[1][0].removed_lines == [2]  # a null id comes first
    assert line_dedup.dedup(docs).columns == docs.columns
    assert line_dedup.report(docs.limit(0)).count() == 0


def test_ngram_join_brute_force(docs):
    found = by_id(ngram_join.join(docs))
    assert found[5][0].class_id == found[6][0].class_id == 5 and found[5][0].n_links == 1
    assert found[2][0].class_id == found[3][0].class_id == 2 and found[1][0].n_links == 1
    assert found[None][0].class_id is None and found[4][0].n_links == 0
    kept = ngram_join.keep_one(docs)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "5", "7", "None"] and kept.columns == docs.columns
    assert ngram_join.join(docs.limit(0)).count() == 0


def test_decontamination_finds_new_values(spark, docs):
    benchmark = spark.createDataFrame([(1, "A train from Paris travels 120 miles in 3 hours before it meets Alice at the 2 stations"), (2, None), (3, "short item")], "item_id bigint, text string")
    extra = spark.createDataFrame([
        (10, "so said A train from Rome travels 77 miles in 9 hours before it meets Carol at the 5 stations today"),
        (11, "nothing like it at all here"),
        (12, None),
    ], "doc_id bigint, text string")
    found = by_id(decontaminate.leaks(extra, benchmark))
    assert set(found) == {10} and found[10][0]["items"] == [1] and not found[10][0].exact
    assert decontaminate.keep_clean(docs, benchmark).count() == len(ROWS)
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0


def test_secrets_match_patterns(docs):
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    texts = ["token=abc123 token = 'x' Token:zzzzzzzz", "AKIA" + "B" * 16, "f" * 24 + " " + "a" * 23, "é token=abcdef", None, "", "ghp_" + "a1" * 18]
    for text, spans in zip(texts, secrets.find(texts), strict=True):
        want = sorted((m.start(), 0, m.end()) for m in assign.finditer(text or "") if len(m[2]) >= 6)
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
        assert sorted(want) == [s for s in spans if s[1] < 3]
    rows = by_id(secrets.scan(docs))
    assert len(rows[1]) == 2 and rows[1][0].n_assign == 1 and rows[2][0].spans == ""


def test_fingerprints(docs):
    rows = by_id(fingerprints.near_edits(docs))
    assert sum(map(len, rows.values())) == len(ROWS) and rows[2][0].fingerprint == rows[3][0].fingerprint
    ordered = [LONG, ROWS[0][1]]
    assert rows[5][0].edited_sha256 == hashlib.sha256((ROWS[6][1][: len(ROWS[6][1]) - len(ROWS[6][1]) // 3] + LONG[: len(ROWS[6][1]) // 3]).encode()).hexdigest()
    assert all(0 <= r.near_next <= 1 for v in rows.values() for r in v) and ordered
    assert rows[6][0].near_next > 0.6
    assert fingerprints.near_edits(docs.limit(0)).count() == 0


def test_pii(docs):
    rows = by_id(pii.scan(docs))
    assert rows[7][0].n_email == 1 and rows[7][0].n_ip == 1 and rows[1][0].n_phone == 1 and rows[3][0].spans == ""
    right = total = 0
    for text, spans in pii._examples(200, 77):
        total += len(spans)
        right += len(set(spans) & set(pii.find(text, pii.train())[1]))
    assert right / total > 0.9


def test_language_model(docs):
    rows = by_id(rnn_lm.score(docs))
    counts = Counter(w for r in ROWS if zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 5 != 1 for w in [*(r[1] or "").encode().lower().split(), None])
    assert sum(map(len, rows.values())) == len(ROWS) and rows[2][0].n_tokens == 1 and rows[4][0].train_tokens == sum(counts.values())
    assert all(r.score < 0 and r.base_score < 0 for v in rows.values() for r in v)
    assert rnn_lm.score(docs.limit(0)).count() == 0


def test_mixing(docs):
    rows = [r for v in by_id(mixing.amounts(docs)).values() for r in v]
    assert len(rows) == len(ROWS) and all(r.taken <= 2 * r["size"] and r.target <= 2 * r.source_size for r in rows)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.amounts(docs.limit(0)).count() == 0


def test_toxicity(docs, labels):
    model = toxicity.fit(docs, labels)
    rows = by_id(toxicity.score(docs, model))
    assert sum(map(len, rows.values())) == len(ROWS) and all(0 <= r.score <= 1 for v in rows.values() for r in v)
    toxic, plain = [f"you {w} fool number {i} of them all" for i in range(60) for w in ("wretched",)], [f"a kind word number {i} of them all" for i in range(60)]
    trained = toxicity.train(toxic[:40], plain[:40])
    trained.calibrate(trained.features(toxic[40:] + plain[40:]), np.repeat([1, 0], 20))
    said = trained.scores(trained.features(["you wretched fool", None, "a kind word", ""]))
    assert said[0] > 0.5 > said[2] and said[1] == said[3]
    clean = toxicity.keep_clean(docs, trained)
    assert clean.columns == docs.columns and clean.count() <= len(ROWS)


def test_token_output_round_trip(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_output.default_tokenizer())
    rows = by_id(token_output.round_trip(docs))
    assert sum(map(len, rows.values())) == len(ROWS)
    for doc_id, text in ((1, ROWS[0][1]), (2, ""), (4, LONG), (7, ROWS[8][1])):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert rows[doc_id][0].n_tokens == len(ids)
        assert rows[doc_id][0].ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
    assert token_output.round_trip(docs.limit(0)).count() == 0
