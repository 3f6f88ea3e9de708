from pyspark.sql import functions as F

from lexmill.functions import numbers, text
from lexmill.operators import graph, merge


def test_number_lists_and_ranges(spark):
    df = spark.createDataFrame([("AAB 3, 7, 9, 20-22, 31 & 40/2012",), ("AAB 14-2018 & AAB 15-2018",), ("none",)], "t string")
    rows = {(r.t[:5], r.year, r.num) for r in numbers.number_pairs(df, F.col("t")).collect()}
    assert {n for t, y, n in rows if y == 2012} == {3, 7, 9, 20, 21, 22, 31, 40}
    assert {n for t, y, n in rows if y == 2018} == {14, 15}


def test_text_rules(spark):
    assert text.folded("[2023] HKCFI 155") == "hkcfi 155"
    assert text.plain_text("<p>a</p><script>x</script><div> b </div>") == "a\nb"
    row = spark.createDataFrame([("HTTP 503 after 3 retries; body: x", "..a b/c_", bytearray(b"PK\x03\x04z"), "12a")], "e string, s string, b binary, c string").select(text.error_class(F.col("e")), text.signature(F.col("s")), text.document_extension(F.col("b")), text.alpha_suffix(F.col("c"))).first()
    assert tuple(row) == ("HTTP 503 after 3 retries", "a_b_c", ".docx", True)


def test_upsert_english_wins_either_way(spark):
    schema = "k int, lang string, seen int"
    a, b = spark.createDataFrame([(1, "tc", 5)], schema), spark.createDataFrame([(1, "en", None), (2, "tc", 7)], schema)
    rules = {"lang": "english_wins", "seen": "new"}
    for old, new in ((a, b), (b, a)):
        out = {r.k: (r.lang, r.seen) for r in merge.upsert(old, new, ["k"], rules).collect()}
        assert out == {1: ("en", 5), 2: ("tc", 7)}


def test_first_wins_with_nulls_and_ties(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, None, "z"), (2, 5, "y"), (2, 5, "x"), (None, 1, "n")], "k int, at int, said string")
    assert {tuple(r) for r in merge.first_wins(rows, ["k"], ["at"]).collect()} == {(1, None, "z"), (2, 5, "x"), (None, 1, "n")}


def test_neighbourhood(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "from_key int, to_key int")
    seeds = spark.createDataFrame([(1,)], "node int")
    assert {(r.node, r.hop) for r in graph.shortest_paths(edges, seeds, hops=2).collect()} == {(1, 0), (2, 1), (3, 2)}
