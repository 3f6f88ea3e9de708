"""Every operator against a plain version of itself: all pairs, patterns, enumerations, counters and finite differences."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexmill.llm import decontaminate, fingerprints, forest, line_dedup, mixing, ngram_join, pii, rnn_lm, secrets, similarity, token_output
from lexmill.session import table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, FOLDER, "documents").cache()


@pytest.fixture(scope="module")
def rows(documents):
    return documents.collect()


def _components(pairs, items):
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def _alike(sets, threshold=0.8):
    return [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) and sets[a] & sets[b]]


def test_lines_all_pairs(documents, rows):
    where = [(r.doc_id, n, line) for r in rows for n, line in enumerate((r.text or "").split("\n")) if line.strip(" \t\r\x0b\x0c")]
    lines = sorted({line for *_, line in where})
    sets = {i: {line[j : j + 8] for j in range(max(1, len(line) - 7))} for i, line in enumerate(lines)}
    pairs = _alike(sets)
    of = _components(pairs, sets)
    number, first = {line: of[i] for i, line in enumerate(lines)}, {}
    for d, n, line in sorted(where, key=lambda w: (w[0], w[1])):
        first.setdefault(number[line], (d, n))
    want = defaultdict(list)
    for d, n, line in where:
        if first[number[line]] != (d, n):
            want[d].append(n)
    found = {r.doc_id: r.removed_lines for r in line_dedup.report(documents).collect()}
    assert {d: sorted(n) for d, n in want.items()} == {d: n for d, n in found.items() if n}
    assert pairs  # there is something to find


def test_ngram_join_all_pairs(documents, rows):
    def shingles(text):
        words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").lower().encode())
        return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()

    of_doc = {r.doc_id: shingles(r.text) for r in rows}
    items = sorted({*of_doc.values()}, key=lambda s: sorted(map(repr, s)))
    index = {s: i for i, s in enumerate(items)}
    pairs = _alike(dict(enumerate(items)))
    of, links, copies = _components(pairs, range(len(items))), Counter(), Counter(index[s] for s in of_doc.values())
    weighted = Counter()
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        weighted[a] += copies[b]
        weighted[b] += copies[a]
    least = {}
    for d in sorted(of_doc):
        least.setdefault(of[index[of_doc[d]]], d)
    found = {r.doc_id: (r.class_id, r.n_links, r.n_text_links) for r in ngram_join.join(documents).collect()}
    want = {d: (least[of[i]], weighted[i] + copies[i] - 1, links[i]) for d, s in of_doc.items() for i in [index[s]]}
    assert found == want and pairs
    met = sum(found[d][2] for d in found)
    assert met >= 0.9 * sum(links[index[of_doc[d]]] for d in of_doc)


def test_forest_recall_and_crowds(spark):
    # 400 pairs at a similarity just over 0.8, and 300 items that share most of one passage, so that runs are crowded.
    rng, sets = random.Random(4), []
    for _ in range(400):
        common, own = [rng.getrandbits(60) for _ in range(90)], [[rng.getrandbits(60) for _ in range(10)] for _ in range(2)]
        sets += [np.unique(np.array(common + o, np.uint64)) for o in own]
    passage = [rng.getrandbits(60) for _ in range(95)]
    sets += [np.unique(np.array(passage + [rng.getrandbits(60) for _ in range(5)], np.uint64)) for _ in range(300)]
    from lexmill.llm.shingles import minhash, multipliers

    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    label = forest.labels(minhash(np.concatenate(sets), at, multipliers(forest.TREES * forest.DEPTH, 3)))
    items = spark.createDataFrame([(i, bytearray(row.tobytes())) for i, row in enumerate(label)], "item bigint, label binary").repartition(3)
    of = {r.node: r.component for r in forest.candidates(items, 0.8).collect()}
    assert sum(2 * i in of and of.get(2 * i) == of.get(2 * i + 1) for i in range(400)) >= 0.99 * 400
    assert len({of.get(i) for i in range(800, 1100)}) == 1
    assert all(forest.met(0.8, [forest.floor_depth(0.8)] * (forest.TREES - c) + [forest.crowded_depth(0.8, c)] * c) >= forest.RECALL for c in range(forest.TREES + 1))
    assert forest.crowded_depth(0.8, 1) == forest.DEPTH > forest.crowded_depth(0.8, forest.TREES - 1)
    assert forest.candidates(items.limit(0), 0.8).count() == 0


def test_large_components_meet_again(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 4)
    text = lambda k, n: " ".join([f"{k}w{i}" for i in range(40)] + [f"x{n}"])
    members = spark.createDataFrame([(1, n, 1, text(n // 3, n)) for n in range(12)] + [(2, 90, 1, "a b"), (2, 91, 1, "a c")], "component bigint, item bigint, weight bigint, text string")
    from lexmill.llm.common import stored

    out = defaultdict(set)
    for r in similarity.refined(stored(members, "members"), ngram_join.sets_of(2)).collect():
        out[r.component].add(r.item)
    assert {frozenset(v) for v in out.values()} == {frozenset(range(i, i + 3)) for i in (0, 3, 6, 9)} | {frozenset((90, 91))}


def test_overlaps_and_links_by_sets():
    rng = random.Random(8)
    sets = [np.unique(np.array([rng.randrange(40) for _ in range(rng.randrange(1, 40))], np.uint64)) for _ in range(30)]
    found = similarity.overlaps(sets[:13], sets[13:])
    assert (found == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[13:]] for a in sets[:13]]).all()


def _template(text):
    marked = re.sub(r"(?:(?<=[^\W\d_] )|(?<=, )|(?<=; ))(?=[A-ZÀ-ÖØ-Þ][a-zß-ÿ])", "", text or "")
    tokens = re.findall("?[^\\W\\d_]+|[0-9]+(?:[.,][0-9]+)*", marked)
    kind = lambda t: "<number>" if t[0].isdigit() else "<name>" if t[0] == "" else "<unit>" if t.lower() in decontaminate.UNITS else t.lower()
    return tokens, [kind(t) for t in tokens]


def test_decontamination_by_loops(spark):
    rng = random.Random(2)
    word = [f"{a}{b}" for a in ("ba", "ce", "di", "fo") for b in ("ra", "se", "ti", "vo", "nu")]
    make = lambda n: " ".join(rng.choice([*word, "Anna", "Paul", "3", "7", "12", "km", "hours"]) for _ in range(n))
    items = {i: make(rng.choice((5, 12, 20, 40))) for i in range(12)}
    texts = {}
    for d in range(80):
        item = items[rng.randrange(12)].split()
        cut = rng.randrange(len(item) + 1)
        part = item[cut : cut + rng.randrange(4, 40)]
        texts[d] = " ".join([make(6), *(rng.choice(("3", "7", "Anna")) if rng.random() < 0.1 else w for w in part), make(6)])
    texts[80], texts[81] = None, ""
    wide, run, want = decontaminate.WINDOW, decontaminate.RUN, set()
    for (d, text), (i, item) in itertools.product(texts.items(), items.items()):
        (mine, own), (theirs, doc) = _template(item), _template(text)
        w = min(wide, len(own))
        plain = lambda ts: [t.lstrip("").lower() for t in ts]
        by_shift = defaultdict(list)
        for at in range(len(own) - w + 1):
            for place in range(len(doc) - w + 1):
                if own[at : at + w] == doc[place : place + w]:
                    by_shift[place - at].append((at, place))
        kept, long = set(), False
        for hits in by_shift.values():
            votes, slots = defaultdict(Counter), {}
            for at, place in hits:
                slots[at] = [(mine[at + j], theirs[place + j]) for j in range(w) if own[at + j].startswith("<")]
                for a, b in slots[at]:
                    votes[a][b] += 1
            value = {a: max(c, key=lambda b, c=c, a=a: (c[b], b == a, b)) for a, c in votes.items()}
            for at, place in hits:
                inside = any(at - k >= 0 and place - k >= 0 and at - k + run <= len(mine) and plain(mine[at - k : at - k + run]) == plain(theirs[place - k : place - k + run]) for k in range(run - wide + 1))
                long |= inside
                if inside or all(b == value[a] for a, b in slots[at]) or all(a == b for a, b in slots[at]):
                    kept.add(at)
        if kept and (len(kept) / (len(own) - w + 1) >= decontaminate.COVERAGE or long):
            want.add((d, i))
    found = decontaminate.leaks(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), spark.createDataFrame(list(items.items()), "item_id bigint, text string"))
    assert {(r.doc_id, i) for r in found.collect() for i in r["items"]} == want and want


def test_fingerprints_near_jaccard(documents, rows):
    order = sorted(rows, key=lambda r: -r.doc_id)
    bag = lambda t: Counter(re.findall(r"[^\x20\x09-\x0d]+", t.lower())) or Counter([""])
    jaccard = lambda a, b: sum((a & b).values()) / sum((a | b).values())
    found, off = {r.doc_id: r for r in fingerprints.near_edits(documents).collect()}, []
    for i, r in enumerate(order):
        text, after = r.text or "", order[(i + 1) % len(order)].text or ""
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        f = found[r.doc_id]
        assert f.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and f.n_chars == len(text)
        off += [f.near_edited - jaccard(bag(text), bag(edited)), f.near_next - jaccard(bag(text), bag(after))]
    off = np.array(off)
    assert (off**2).mean() ** 0.5 < 0.075 and abs(off.mean()) < 0.015


def test_secrets_by_patterns():
    patterns = [re.compile(p, (re.I if fold else 0) | re.A) for _, p, fold, _ in secrets.RULES]
    bits = ["password", "token", "api_key", "secret", "=", ":", " ", '"', "'", "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef", "ghp_", "xoxb-", "eyJ", "a.", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "é", "-", "_", "\n", "x" * 36, ".eyJ", "eyJab.eyJcd.ef"]
    rng = random.Random(5)
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(3000)]
    want = [sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in p.finditer(t) if secrets._passes(k, m[0].encode())) for t in texts]
    assert secrets.find(texts) == want
    assert len(secrets.find(["eyJ" * 20_000, "token=" * 10_000])[1]) == 1  # linear, or this takes minutes


def test_personal_data_by_patterns_and_enumeration():
    bits = ["a", "b.c", "@", ".", "1", "255", "256", "10.0.0.1", " ", "-", "+1 ", "4111 1111 1111 1111", "+44 (20) 7946-0958", "x@y.zz", "é", "²", "1.2.3.²", "%", "\n", "("]
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(18)))
        assert pii.base_spans(text) == [(k, m.start(), m.end()) for k, p in enumerate(pii.PATTERNS) for m in p.finditer(text) if pii._passes(k, m[0])]
    weights = pii.train()
    assert pii.find("see 1.2.3.² now, 1.2.3.① and +1 (743) 555-3824", weights)[0] == [(3, 29, 46)]
    assert len(pii.find("a" * 80_000 + " x@y.com " + "1" * 80_000 + " 1.2", weights)[0]) == 1
    for text, _ in pii._examples(12, 5):
        base = set(pii.base_spans(text))
        for run in pii.windows(text):
            if len(run) > 6:
                continue
            best = -1e9
            for cuts in itertools.product((0, 1), repeat=max(0, len(run) - 1)):  # all segmentations; a single token may also be none
                edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(run)]
                score = 0.0
                for i, j in itertools.pairwise(edges):
                    a, b = pii._trim(text, run[i][0], run[j - 1][1])
                    own = (weights @ pii.features(text, a, b, j - i, base)).max() if a < b and j - i <= pii.LONGEST else -1e9
                    score += max(own, 0.0) if j - i == 1 else own
                best = max(best, score)
            chosen = sum(float((weights @ pii.features(text, a, b, sum(a <= s < b for s, _ in run), base))[k]) for k, a, b in pii.decode(text, run, weights, base))
            assert abs(chosen - best) < 1e-6


def test_language_model_counts_and_slopes(documents, rows, monkeypatch):
    words = {r.doc_id: re.findall(rb"[^\x20\x09-\x0d]+", (r.text or "").encode().lower()) for r in rows}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in words}
    counts = Counter(w for d, ws in words.items() if not held[d] for w in [*ws, None])
    total, norm = sum(counts.values()), np.log10(sum(counts.values()) + 0.5 * (len(counts) + 1))
    gain = []
    for r in rnn_lm.score(documents).collect():
        tokens = [*words[r.doc_id], None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(tokens), sum(t in counts for t in tokens), total)
        assert abs(r.base_score - sum(np.log10(counts[t] + 0.5) - norm for t in tokens)) < 1e-6 * max(1, len(tokens))
        gain.append((r.score - r.base_score) / len(tokens))
    assert np.isfinite(gain).all()
    # Slopes by differences, in a window that is not cut and lanes of different lengths.
    rng = np.random.default_rng(1)
    p = {k: (v + rng.standard_normal(v.shape) * 0.2).astype(np.float32) for k, v in rnn_lm.initial(np.full(rnn_lm.VOCABULARY, 5.0)).items()}
    docs = [rng.integers(0, 300, n).astype(np.int32) for n in (20, 9, 14, 3)]
    after = {k: v.copy() for k, v in p.items()}
    scale = 1e4
    rnn_lm.run(after, docs, 3, {k: np.full_like(v, scale**2) for k, v in p.items()})
    loss = lambda q: -rnn_lm.run(q, docs, 3).sum()
    for k in p:
        slope = (p[k].astype(float) - after[k]) * scale / rnn_lm.RATE
        for at in [np.unravel_index(np.abs(slope).argmax(), slope.shape), *(np.unravel_index(i, slope.shape) for i in np.argsort(-np.abs(slope), axis=None)[3:6])]:
            ends = []
            for step in (0.02, -0.02):
                q = {n: v.copy() for n, v in p.items()}
                q[k][at] += step
                ends.append(loss(q))
            assert abs((ends[0] - ends[1]) / 0.04 - slope[at]) < 0.03 * abs(slope[at]) + 0.05, (k, at)


def test_long_document_takes_memory_by_its_tokens():
    dealt = rnn_lm.lanes([np.zeros(200_000, np.int32), *(np.zeros(5, np.int32) for _ in range(600))], 64)
    assert len(dealt.target) == 203_000 and dealt.length[0] == 200_000 and dealt.begins.sum() == 601


def test_mixing_of_empty_texts_and_ties(spark):
    rows = [(i, "", "a") for i in range(5)] + [(9, "one two", "a"), (None, "x y z", None), (None, "u v w", None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    taken = Counter((r.doc_id, r.text) for r in mixing.mix(docs).collect())
    assert max(taken.values()) <= mixing.CAP
    assert all(r.taken <= mixing.CAP * r["size"] for r in mixing.amounts(docs).collect())


def test_clashing_columns_are_kept(spark):
    rows = [(i, "a line that is here twice", "s", *["keep"] * 5) for i in (1, 2)] + [(None,) * 8]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _id string, _hash string, _gone string, id string, removed string")
    benchmark = spark.createDataFrame([(1, "nothing of it")], "item_id bigint, text string")
    for out, n in ((line_dedup.dedup(docs), 3), (ngram_join.keep_one(docs), 2), (decontaminate.keep_clean(docs, benchmark), 3), (mixing.mix(docs), None)):
        assert out.columns == docs.columns
        kept = out.collect()
        assert n in (None, len(kept)) and {(r._id, r._hash, r._gone, r.id, r.removed) for r in kept} <= {("keep",) * 5, (None,) * 5}
    assert sorted(str(r.text) for r in line_dedup.dedup(docs).collect()) == ["", "None", "a line that is here twice"]


def test_token_ids_of_all_documents(documents, rows):
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(token_output.default_tokenizer()), 0
    found = {r.doc_id: r for r in token_output.round_trip(documents).collect()}
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (found[r.doc_id].start, found[r.doc_id].n_tokens, found[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_pipeline_stages(spark, documents):
    import corpus_pipeline

    docs, names = documents.unionByName(spark.createDataFrame([(None, None, None, None, None)], documents.schema)), []
    clean = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == documents.columns
        docs = out.cache()
        kept = [r.doc_id for r in docs.collect()]
        assert set(kept) <= clean and (name == "mixing" or len(kept) == len(set(kept)))
        if name != "mixing":
            assert len(kept) > 0.6 * len(clean)
        clean = set(kept)
        names.append(name)
    assert names == ["toxicity", "ngram_join", "decontamination", "mixing"]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert last.count() == docs.count()
