"""Each test fails where an operator does less than its whole job."""

import numpy as np
from pyspark.sql import functions as F

from lexmill.llm import decontaminate, fingerprints, rnn_lm


def test_fingerprint_samples_have_draws_of_their_own(spark):
    # One term with weights 4 and 5 agrees in a sample if its t is equal: with probability 0.8, and in each sample on its own.
    words = [f"w{i}" for i in range(60)]
    texts = spark.createDataFrame([(w, n, " ".join([w] * n)) for w in words for n in (4, 5)], "name string, n int, text string")
    prints = {(r.name, r.n): r.fingerprint for r in fingerprints.fingerprints(texts, ["name", "n"]).collect()}
    width = fingerprints.DIGITS
    same = [[prints[w, 4][i : i + width] == prints[w, 5][i : i + width] for i in range(0, len(prints[w, 4]), width)] for w in words]
    assert all(len(row) >= 64 for row in same)
    assert abs(sum(map(sum, same)) / sum(map(len, same)) - 0.8) < 0.03
    for apart in (1, 2, 4, 8):
        pairs = [(row[i], row[i ^ apart]) for row in same for i in range(len(row))]
        both = sum(a and b for a, b in pairs) / len(pairs)
        assert abs(both - 0.64) < 0.04, apart  # 0.8 where the two share their draws


def test_decontamination_drops_only_what_disagrees(spark):
    words = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu") for b in ("ra", "se", "ti", "vo", "nu", "la")]
    long, thirteen = words[:59], words[20:33]
    roles = "she buys 3 apples in the small shop near the old mill and later sells 3 pears to her friend at the harbour"
    benchmark = spark.createDataFrame([(1, " ".join(long)), (2, roles)], "item_id bigint, text string")
    documents = spark.createDataFrame([
        (1, "x y " + " ".join(long[10:32]) + " z"),  # 15 of 52 windows
        (2, " ".join(["x", *thirteen, "y"])),
        (3, " ".join(["x", *thirteen[:-1], "y"])),  # a token short of a run
        (4, roles.replace("3 apples", "5 apples").replace("3 pears", "7 pears")),
        (5, roles.replace("3 pears", "7 pears")),
        (6, roles),
    ], "doc_id bigint, text string")
    found = {r.doc_id: (r["items"], r.exact) for r in decontaminate.leaks(documents, benchmark).collect()}
    assert found == {1: ([1], True), 2: ([1], True), 4: ([2], False), 5: ([2], False), 6: ([2], True)}


def test_language_model_trains_on_from_the_average(spark, monkeypatch):
    begun, flat = [], rnn_lm._flat
    monkeypatch.setattr(rnn_lm, "_flat", lambda p: begun.append(flat(p)) or begun[-1])
    texts = spark.createDataFrame([(i, f"red green blue {i % 3} grey") for i in range(40)], "doc_id bigint, text string").repartition(2)
    words, vocabulary = rnn_lm.words_of(rnn_lm.count_words(texts))
    rnn_lm.train(texts, words, vocabulary)
    assert len(begun) >= 2 and (begun[0] != begun[1]).any()
    assert rnn_lm.TRAIN_LANES <= 64


def test_fingerprint_limits_lose_no_sample(spark, monkeypatch):
    # Limits that leave most texts without a value in some sample: these are drawn again, and all prints are as with limits that fit.
    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(i % 40))) for i in range(120)] + [(500, None), (501, "a " * 3000), (502, None)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    draws = fingerprints.common_draws(documents, head=64)
    none = fingerprints._prints(documents.withColumn("side", F.lit(0)), ["doc_id"], ("fingerprint",), fingerprints.SAMPLES, draws, limits=False)
    want = {r.doc_id: r.fingerprint for r in none.collect()}
    assert len(want) == len(rows) and all(len(x) == fingerprints.SAMPLES * fingerprints.DIGITS for x in want.values())
    assert {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(documents, ["doc_id"], draws=draws).collect()} == want
    monkeypatch.setattr(fingerprints, "CLOSE", 3)
    tight = fingerprints._prints(documents.withColumn("side", F.lit(0)), ["doc_id"], ("fingerprint",), fingerprints.SAMPLES, draws, limits=True)
    assert tight.where("fingerprint is null").count() > 50
    assert {r.doc_id: r.fingerprint for r in fingerprints.near_edits(documents).collect()} == want


def test_language_model_pads_little(monkeypatch):
    # Words as in texts: a few classes have most rows, and most classes have a few each. Of each token 64 classes, its class's 32 words
    # and 48 gates need an exponential or a tangent; padding may add a third.
    rng = np.random.default_rng(1)
    rank = np.exp(rng.uniform(0, np.log(20_000), 64 * 32 * 6)).astype(int)
    docs = np.split(np.minimum(rank, rnn_lm.VOCABULARY - 1).astype(np.int16), 64)
    done = []
    for name in ("exp", "tanh"):
        plain = getattr(np, name)
        monkeypatch.setattr(np, name, lambda x, *a, plain=plain, **b: done.append(np.size(x)) or plain(x, *a, **b))
    p = rnn_lm.initial(np.full(rnn_lm.VOCABULARY, 5.0))
    rnn_lm.run(p, docs, 64, {k: np.full_like(v, 1e-3) for k, v in p.items()})
    assert all(np.isfinite(v).all() for v in p.values())
    assert sum(done) / len(rank) < (64 + 32 + 48) * 4 / 3


def test_language_model_finds_every_head_word():
    # By first bits or not, a hash is found where the head has it and nowhere else; also the smallest, the largest and close ones.
    near = np.arange(7, dtype=np.uint64) + np.uint64(1 << 63)
    hashes = np.unique(np.concatenate((np.random.default_rng(2).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2), near, np.array([0, (1 << 64) - 1], np.uint64))))
    words = rnn_lm.Words(hashes, np.arange(len(hashes)) % rnn_lm.VOCABULARY, np.zeros(len(hashes)), 1, 1, 1.0, 0)
    asked = np.concatenate((hashes, hashes + np.uint64(1), hashes - np.uint64(1)))
    at, number = rnn_lm._numbers(words, rnn_lm._places(words), asked)
    own = {h: i for i, h in enumerate(hashes.tolist())}
    assert at.tolist() == [own.get(h, len(hashes)) for h in asked.tolist()]
    assert number.tolist() == [own[h] % rnn_lm.VOCABULARY if h in own else rnn_lm.VOCABULARY - 1 for h in asked.tolist()]
