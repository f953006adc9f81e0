import pytest
from pyspark.sql import functions as F

from catalink.operators import graph, mlprep, profile


def test_closure_with_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), (None, "z")], "p string, c string")
    got = {(r.ancestor, r.descendant): r.steps for r in graph.closure(e, "p", "c").collect()}
    assert got == {("a", "b"): 1, ("b", "c"): 1, ("c", "a"): 1, ("a", "c"): 2, ("b", "a"): 2, ("c", "b"): 2, ("a", "a"): 3, ("b", "b"): 3, ("c", "c"): 3}
    with pytest.raises(ValueError):
        graph.closure(spark.createDataFrame([(i, i + 1) for i in range(6)], "p int, c int"), "p", "c", depth=3)
    assert graph.closure(e.limit(0), "p", "c").count() == 0


def test_taxonomy_in_any_order(spark):
    n = spark.createDataFrame([("AB", "A", "x"), ("A", None, "y")], "c string, p string, l string")
    assert {r.code: r.path for r in graph.taxonomy_paths(n, "c", "p").collect()} == {"A": "ROOT/A", "AB": "ROOT/A/AB"}
    t = {(r.s, r.o) for r in graph.skos(n, "c", "l", "p", "x:").collect()}
    assert ("x:ROOT", "x:A") in t and ("x:A", "x:AB") in t and ("x:AB", "AB - x") in t


def test_triples(spark):
    rows = spark.createDataFrame([("1", "t", ["a", "", None]), ("1", "t", ["a"]), ("2", None, None)], "id string, t string, a array<string>")
    t = graph.emit(rows, F.concat(F.lit("x:"), "id"), [("p:t", F.col("t"), "literal", None, "fr"), ("p:a", F.col("a"), "literal", None, None)])
    assert {(r.s, r.p, r.o) for r in t.collect()} == {("x:1", "p:t", "t"), ("x:1", "p:a", "a")}
    assert t.count() == 2
    lines = {r.value for r in graph.n_triples(t).collect()}
    assert '<x:1> <p:t> "t"@fr .' in lines
    assert graph.hop(spark.createDataFrame([("b", "by", "a1"), ("a1", "name", "Roy")], "s string, p string, o string"), "by", "name").first().label == "Roy"


def test_profiles(spark):
    rows = spark.createDataFrame([("a", ""), ("a", None), ("b", "x" * 120)], "p string, q string")
    f = profile.top_values(profile.column_values(rows), 1)
    assert {r.path: (r.n, r.non_null) for r in f.collect()} == {"p": (2, 3), "q": (1, 1)}
    shown = profile.top_values(profile.column_values(rows), 5).where("path = 'q' and length(value) > 10").first().value
    assert len(shown) == 77
    nested = spark.createDataFrame([([{"t": "x", "l": ["a", ""]}, {"t": None, "l": ["a"]}],)], "s array<struct<t:string,l:array<string>>>")
    assert {(r.path, r.value): r.n for r in profile.nested_values(nested).collect()} == {("s.t", "x"): 1, ("s.l", "a"): 2}
    d = profile.describe(spark.createDataFrame([(1.0,), (0.0,), (None,)], "v double"), F.col("v")).first()
    assert (d.n, d.n_null, d["max"], d.min_non_zero, d["median"]) == (2, 1, 1.0, 1.0, 0.5)
    assert profile.describe(spark.createDataFrame([], "v double"), F.col("v")).first().n == 0


def test_learning(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "i int, t string")
    chosen, rest = mlprep.sample_split(rows, 5, ["i"])
    assert chosen.count() == 5 and rest.count() == 15
    assert mlprep.balanced(rows, rows, 3, ["i"]).groupBy("label").count().count() == 2
    vocab = mlprep.vocabulary(rows, mlprep.characters(F.col("t")))
    seq = mlprep.sequences(spark.createDataFrame([(1, "t1"), (2, None)], "k int, t string"), "k", mlprep.characters(F.col("t")), vocab, 4)
    got = {r.k: r.features for r in seq.collect()}
    assert got[2] == [0, 0, 0, 0] and got[1][:2] == [0, 0] and got[1][2] == 1
    m = mlprep.metrics(spark.createDataFrame([(1, 1), (0, 1), (0, 0), (1, 0)], "y int, p int"), F.col("y"), F.col("p")).first()
    assert (m.tp, m.fp, m.tn, m.fn, m.accuracy, m.f1) == (1, 1, 1, 1, 0.5, 0.5)
    assert mlprep.metrics(spark.createDataFrame([], "y int, p int"), F.col("y"), F.col("p")).first().precision is None
    v = mlprep.character_means(spark.createDataFrame([("ab", [1.0, 2.0]), ("b", [3.0, 4.0])], "w string, v array<double>"), "w", "v")
    assert {(r.ch, r.i): r.mean for r in v.collect()} == {("a", 0): 1.0, ("a", 1): 2.0, ("b", 0): 2.0, ("b", 1): 3.0}
    t = spark.range(1).select(mlprep.tempered(F.array(F.lit(0.5), F.lit(0.5)), 0.2)).first()[0]
    assert t == [0.5, 0.5]
    w = spark.createDataFrame([("abcdefgh",)], "t string").select(F.explode(mlprep.ngram_windows(F.col("t"), 4, 3)).alias("w")).select("w.*").collect()
    assert [(r.window, r.next) for r in w] == [("abcd", "e"), ("defg", "h")]
