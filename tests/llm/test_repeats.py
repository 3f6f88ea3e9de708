"""Rows that repeat a text and an id are one item wherever texts are moved."""

from lexmill.llm import components, decontaminate, ngram_join


def test_repeated_rows_are_moved_once(spark, monkeypatch):
    counts, whole = {}, ngram_join.stored

    def stored(df, name, by=None):
        out = whole(df, name, by)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "stored", stored)
    words = [f"word{i}" for i in range(60)]
    rows = [(None, " ".join(words))] * 3000 + [(1, " ".join([*words[:-1], "other"])), (2, "nothing like it at all here")]
    found = ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert counts["ngram-members"] == 2
    assert sum(r.doc_id is None and r.class_id == 1 and r.n_links == 3000 for r in found) == 3000
    assert {(r.doc_id, r.class_id, r.n_links) for r in found if r.doc_id is not None} == {(1, 1, 3000), (2, 2, 0)}


def test_components_by_steps_and_by_one_task(spark, monkeypatch):
    import random

    draw = random.Random(3)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 50)]
    union = components.Union()
    for a, b in edges:
        union.join(a, b)
    want = {(n, union.find(n)) for a, b in edges if a != b for n in (a, b)}
    frame = spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)
    for most in (0, 500_000):
        monkeypatch.setattr(components, "REMAINDER", most)
        assert {tuple(r) for r in components.connected_components(frame).collect()} == want
    assert components.connected_components(frame.limit(0)).count() == 0


def test_a_window_that_many_items_share(spark):
    """A document in which a stock phrase of 300 items stands 50 times: no row gathers its 15,000 hits, and only what is asked
    for in full is found; items of five widths are looked for in one pass."""
    stock = "please choose the one right answer from these options"
    ends = [" ".join(f"{chr(97 + i % 26)}{chr(97 + j)}{chr(97 + i // 26)}word" for j in range(20)) for i in range(300)]
    short = [(1000 + n, " ".join(f"{chr(97 + n)}{chr(97 + j)}tiny" for j in range(n))) for n in range(3, 8)]
    items = spark.createDataFrame([*((i, f"{stock} {end}") for i, end in enumerate(ends)), *short], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, " so ".join([stock] * 50)), (2, f"well {stock} {ends[7]} and more"), (3, " and then ".join(t for _, t in short)), (4, None)], "doc_id bigint, text string")
    got = {(r.id, r.item_id) for r in decontaminate.matches(docs, items).collect()}
    assert got == {(2, 7), *((3, i) for i, _ in short)}
