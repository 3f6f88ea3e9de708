"""Buckets, hub counts, anchors, schemas and header changes: plans, nulls, ties, empty input, conflicts and crashes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexmill.functions import html
from lexmill.operators import hub_cache, merge, schemas, stats
from lexmill.plans import upkeep
from lexmill.session import working_path
from lexmill.sources import buckets, versions


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _state(spark, rows, **more):
    path = working_path(spark, "test-state")
    buckets.create(spark.createDataFrame(rows, "k bigint, v string, n bigint"), path, ["k"], **more)
    return path


def test_merge_moves_only_the_delta(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        path = _state(spark, [(i, f"v{i}", i) for i in range(200)], slots=4, buckets=4)
        delta = spark.createDataFrame([(i, None, 1) for i in range(190, 210)], "k bigint, v string, n bigint")
        plan = _plan(merge.upsert(buckets.state(spark, path), delta, ["k"], {"v": "new", "n": "sum"}))
        joined = plan[plan.index("SortMergeJoin") :]
        assert joined.count("Exchange hashpartitioning") == 1  # the delta's
        assert "Bucketed: true" in joined[: joined.index("Exchange")]
        buckets.upsert(spark, path, delta, {"v": "new", "n": "sum"})
        want = {(i, f"v{i}" if i < 200 else None, i + 1 if 190 <= i < 200 else i if i < 190 else 1) for i in range(210)}
        assert {tuple(r) for r in buckets.state(spark, path).collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_untouched_slots_stay_where_they_are(spark):
    path = _state(spark, [(i, "a", 0) for i in range(100)], slots=8, buckets=2)
    _, before, _ = buckets._read(spark, path, None)
    buckets.upsert(spark, path, spark.createDataFrame([(5, "b", 9)], "k bigint, v string, n bigint"), {"v": "new"})
    number, after, _ = buckets._read(spark, path, None)
    assert number == 2 and len(before) == 8 and sum(before[s] != after[s] for s in before) == 1
    assert buckets.state(spark, path).where("k = 5").first().v == "b" and buckets.state(spark, path, 1).where("k = 5").first().v == "a"
    assert buckets.state(spark, path).count() == 100


def test_states_edges(spark):
    path = _state(spark, [], slots=2, buckets=2)
    assert buckets.state(spark, path).count() == 0
    none = spark.createDataFrame([], "k bigint, v string, n bigint")
    buckets.upsert(spark, path, none, {})
    buckets.upsert(spark, path, spark.createDataFrame([(None, "null", 1), (1, "it's", None)], none.schema), {})
    buckets.upsert(spark, path, spark.createDataFrame([(1, None, 4)], none.schema), {"n": "new"})
    assert {tuple(r) for r in buckets.state(spark, path).collect()} == {(None, "null", 1), (1, "it's", 4)}
    with pytest.raises(ValueError, match="twice"):
        buckets.upsert(spark, path, spark.createDataFrame([(1, "x", 1), (1, "y", 1)], none.schema), {})
    with pytest.raises(FileNotFoundError):
        buckets.state(spark, working_path(spark, "nothing"))


def test_two_merges_from_one_version(spark):
    path = _state(spark, [(1, "a", 0)], slots=2, buckets=2)
    schema = "k bigint, v string, n bigint"

    def late(old, new):
        buckets.upsert(spark, path, spark.createDataFrame([(2, "first", 0)], schema), {})
        return merge.upsert(old, new, ["k"], {})

    with pytest.raises(versions.Conflict):
        buckets.changed(spark, path, spark.createDataFrame([(3, "second", 0)], schema), late)
    assert {r.k for r in buckets.state(spark, path).collect()} == {1, 2}


def test_hub_counts_after_deltas_and_a_crash(spark):
    draw, path = random.Random(3), working_path(spark, "test-hubs")
    frame = lambda rows: spark.createDataFrame(rows, "from_key bigint, to_key string")
    deltas = [[(draw.randrange(30), f"c{draw.randrange(6)}") for _ in range(60)] for _ in range(3)]
    hub_cache.create(spark, path, frame([]), slots=2, parts=2)
    hub_cache.add(spark, path, frame([*deltas[0], (None, "c1"), (1, None)]))
    # Edges of the second delta are committed, their counts are not.
    new = buckets.absent(spark, f"{path}/edges", frame(deltas[1]).distinct()).withColumn("since", F.lit(3))
    buckets.upsert(spark, f"{path}/edges", new, {})
    hub_cache.add(spark, path, frame(deltas[2]))
    hub_cache.add(spark, path, frame([]))
    edges = {e for d in deltas for e in d}
    assert {tuple(r) for r in hub_cache.hubs(spark, path).collect()} == {(c, sum(t == c for _, t in edges)) for c in {t for _, t in edges}}


def test_hub_buckets_grow_with_the_edges(spark, monkeypatch):
    path = working_path(spark, "test-hubs")
    monkeypatch.setattr(upkeep, "working_path", lambda *_: path)
    monkeypatch.setattr(hub_cache, "EDGES", 500)
    upkeep.hub_deltas(spark, "/root/testdata/sf0.001")
    edges = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert buckets._read(spark, f"{path}/edges", None)[2].buckets == -(-edges // 500) > 4


def test_anchors_of_odd_pages():
    found = html.page_anchors("<div><a href=x>a <b>b</b>&amp;<br>c</a><a name=n>no</a><A HREF='y'>open<a href=\"z\">")
    assert [(a["href"], a["text"], a["depth"], a["closed"]) for a in found] == [("x", "a b&c", 1, True), (None, "no", 1, True), ("y", "open", 1, False), ("z", "", 2, False)]
    assert html.page_anchors(None) == html.page_anchors("") == html.page_anchors("<!-- <a href=x>x</a> --><script>'<a href=y>'</script>") == []
    within = html.page_anchors("<a href=f.pdf>one <a href=other>two</a> three</a>", re.compile("pdf$"))
    assert [(a["href"], a["text"]) for a in within] == [("f.pdf", "one two")]
    assert len(html.page_anchors("<p><a href='x'>t</a>" * 20_000)) == 20_000


def test_anchors_as_rows(spark):
    pages = spark.createDataFrame([(1, "<a href=/tc/other/a_1>x</a><a href='/en/other/a_1/y'>y</a>"), (2, None), (3, "")], "position bigint, html string").withColumnRenamed("position", "page")
    assert [tuple(r) for r in html.with_anchors(pages).select("page", "position", "href").collect()] == [(1, 0, "/tc/other/a_1"), (1, 1, "/en/other/a_1/y")]
    assert [tuple(r) for r in html.database_matrix(pages).collect()] == [("other", "a_1", ["en", "tc"])]


def test_pages_go_to_python_row_by_row(spark):
    plan = _plan(html.with_anchors(spark.createDataFrame([(1, "<a href=x>t</a>")], "page int, html string")))
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_schema_faults(spark):
    schema = {
        "type": "object", "required": ["a"], "additionalProperties": {"type": "number", "maximum": 9},
        "properties": {"a": {"enum": ["x", 1, None, True]}, "b b": {"type": "array", "minItems": 2, "items": {"type": ["integer", "null"], "minimum": 0}}, "c": {"type": "object", "additionalProperties": False, "properties": {"d": {"const": 2}}}},
    }
    cases = {
        '{"a": "x"}': [], '{"a": 1.0}': [], '{"a": null}': [], '{"a": true}': [], '{"a": false}': ['$.a: none of ["x", 1, null, true]'], "{}": ["$: lacks a"], "[]": ["$: not object"],
        '{"a": 1, "b b": [1, null, 2.0]}': [], '{"a": 1, "b b": [-1, "s", 1.5, -2]}': ["$.b b[]: minimum 0", "$.b b[]: not integer or null"], '{"a": 1, "b b": [1]}': ["$.b b: under 2 items"],
        '{"a": 1, "b b": {}}': ["$.b b: not array"], '{"a": 1, "c": {"d": 2}}': [], '{"a": 1, "c": {"d": "2", "e": 0}}': ["$.c.d: none of [2]", "$.c.e: not allowed"], '{"a": 1, "z": 5}': [],
        '{"a": 1, "z": "5"}': ["$.*: not number"], '{"a": 1, "z": 10}': ["$.*: maximum 9"], "{": ["not JSON"], "": [], "  ": [], "null": ["$: not object"],
    }
    rows = spark.createDataFrame([*enumerate(cases), (99, None)], "fault_id int, line string")
    found = {}
    for r in schemas.json_faults(rows, schema).collect():
        found.setdefault(r.fault_id, []).append(r.fault)
    assert {i: sorted(found.get(i, [])) for i in range(len(cases))} == dict(enumerate(sorted(f) for f in cases.values())) and 99 not in found


def test_schema_is_compiled_whole_and_parsed_once(spark):
    with pytest.raises(ValueError, match="pattern"):
        schemas.compiled({"properties": {"a": {"type": "string", "pattern": "x"}}}, F.lit(None))
    with pytest.raises(ValueError, match="constant"):
        schemas.compiled({"oneOf": [{"properties": {"a": {"type": "string"}}}]}, F.lit(None))
    rows = spark.createDataFrame([(1, "{}")], "id int, line string")
    plan = schemas.json_faults(rows, {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "string"}}})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.count("parseJson") <= 1 or len(re.findall(r"AS _value#", plan)) == 1


def test_header_changes(spark):
    pairs = [(None, {"A": "1"}), ({"a": "1", "B": "2"}, {"A": "1", "b": "3"}), ({"x": None}, {"x": ""}), ({"x": None, "y": "1"}, {"X": None}), (None, None), ({"Q": "1", "q": "2"}, {"q": "2"})]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, old map<string,string>, new map<string,string>")
    got = {r.i: [tuple(c) for c in r.c] for r in rows.select("i", stats.header_changes(F.col("old"), F.col("new")).alias("c")).collect()}
    assert got == {0: [("a", "added", None, "1")], 1: [("b", "changed", "2", "3")], 2: [("x", "changed", None, "")], 3: [("y", "gone", "1", None)], 4: [], 5: []}
