import json

import pandas as pd
import pytest

from lexmill.functions import payloads
from lexmill.operators import graph
from lexmill.sources import files
from lexmill.streaming import ingest, replay


def test_stems(spark):
    names = ["a_1.tc.html", "a_1.html", "a_1.appeal_history.json", "a_1.pdf", "noext", None, ".tc.html", ".html", "a.tc.docx", "a.html.html"]
    out = spark.createDataFrame([(n,) for n in names], "name string").select(payloads.stem(payloads.F.col("name")).alias("s"), payloads.suffix(payloads.F.col("name")).alias("x"))
    assert [tuple(r) for r in out.collect()] == [("a_1", ".tc.html"), ("a_1", ".html"), ("a_1", ".appeal_history.json"), (None, None), (None, None), (None, None), ("", ".tc.html"), (None, None), ("a.tc", ".docx"), ("a.html", ".html")]


def test_challenge_page(spark):
    pages = ["<title>JUST A MOMENT...</title>", "just a moment.", "x 系統維護", "", None]
    out = spark.createDataFrame([(p,) for p in pages], "html string").select(payloads.challenge_page(payloads.F.col("html")).alias("c"))
    assert [r.c for r in out.collect()] == [True, False, True, False, False]


def test_noteup_positions_count_entries_that_go(spark):
    body = json.dumps([{"path": None}, {"path": "/tc/cases/abc/2001/7", "citation_frequency": 2, "parallel": ["", "p"]}, {"path": "/en/other/x/2001/7"}, {"path": "/en/cases/abc/2001/8/"}])
    rows = payloads.noteup_edges(spark.createDataFrame([("t", body), ("u", "{}"), ("v", None), ("w", "[]")], "k string, body string"), "k", "body").collect()
    assert sorted((r.from_key, r.to_key, r.citer_lang, r.citer_freq, r.position, r.parallel) for r in rows) == [("abc/2001/7", "t", "tc", 2, 1, ["p"]), ("abc/2001/8", "t", "en", None, 3, None)]


def test_holds_is_containment(spark):
    texts = ["xa b c d ey", "a b c d e", "a b c  d e", "", None, "short one", "a b c d"]
    needles = ["a b c d e", "short", None, "b c d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame(list(enumerate(needles)), "item_id bigint, text string")
    want = {(d, i) for d, t in enumerate(texts) for i, n in enumerate(needles) if t is not None and n is not None and n in t}
    assert {tuple(r) for r in payloads.holds(docs, items).collect()} == want
    assert {tuple(r) for r in payloads.holds(docs, items, broadcast_chars=0, short_chars=3).collect()} == want


def test_shortest_paths(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (9, 9)], "from_key bigint, to_key bigint")
    out = graph.shortest_paths(edges, spark.createDataFrame([(1,)], "node bigint"))
    assert {tuple(r) for r in out.collect()} == {(1, 0, None), (2, 1, 1), (3, 1, 1), (4, 2, 3)}


def test_circuit_breaker(spark):
    # five failures kill at 5; the failure at 100 is ignored; revived at 305; a success at 308 resets the count
    rows = [(1, float(t), False) for t in (1, 2, 3, 4, 5, 100, 306, 307, 309, 310)] + [(1, 308.0, True), (2, 1.0, False), (None, 1.0, False)]
    out = replay.circuit_breaker(spark.createDataFrame(rows, "proxy bigint, at double, ok boolean")).collect()
    assert sorted(tuple(r) for r in out) == [(1, 5.0, "dead"), (1, 305.0, "revived")]


def test_event_log_and_append(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.createDataFrame([("2024-01-01 00:00:00", "warmup"), ("2024-01-01 00:10:00", "warmup")], "ts string, kind string").selectExpr("cast(ts as timestamp) ts", "kind").transform(lambda d: files.append_events(d, path) or d)
    (tmp_path / "events" / "bad.txt").write_text("no json\n")
    assert [r.kind for r in files.event_log(spark, path).collect()] == ["warmup"] * 2


def test_inventory(spark, tmp_path):
    folder = tmp_path / "hkcfi" / "2001"
    folder.mkdir(parents=True)
    (folder / "hkcfi_2001_1.html").write_text("<p>x")
    (tmp_path / "other.html").write_text("x")
    assert [(r.name, r.length) for r in files.inventory(spark, str(tmp_path)).collect()] == [("hkcfi_2001_1.html", 4)]


def test_ingest_hands_over_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen: list[pd.DataFrame] = []
    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"a": i}))
        ingest.ingest(spark.readStream.schema("a bigint").json(str(tmp_path / "in")), lambda b, n: seen.append(b.toPandas()), str(tmp_path / "log")).awaitTermination()
    assert [x["a"].tolist() for x in seen] == [[0], [1]]


@pytest.mark.parametrize("n", [0, 1])
def test_anchors(spark, n):
    html = "<p>x</p>" + n * '<a class="c" href="/a">t</a><a href="/b">'
    rows = payloads.anchors(spark.createDataFrame([(html,), (None,)], "html string")).collect()
    assert [(r.position, r.href) for r in rows] == n * [(0, "/a"), (1, "/b")]
