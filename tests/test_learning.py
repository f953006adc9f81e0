import math

from pyspark.sql import functions as F

from catalink.functions import text
from catalink.operators import graph, mlprep


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_brackets_nested_deeper_than_any_table(spark):
    deep = "a" + "(x" * 14 + ")" * 14 + "b (c"
    assert one(spark, text.strip_parens, deep) == "ab (c"
    assert one(spark, text.strip_parens, None) is None
    assert one(spark, lambda c: text.text_in_parens(c, first_only=True), "(a(b)) (c)") == ["(b)", "(a)"]


def test_numbers_follow_the_order(spark):
    rows = spark.range(1000).withColumn("k", F.xxhash64("id")).repartition(7)
    got = [r.id for r in mlprep.numbered(rows, [F.col("id").desc()], "n").orderBy("n").collect()]
    assert got == list(range(999, -1, -1))
    assert mlprep.numbered(rows.limit(0), [F.col("id")], "n").count() == 0


def test_sample_with_replacement_has_the_share_asked_for(spark):
    n = mlprep.with_replacement(spark.range(40_000), 0.1, ["id"]).groupBy("id").count()
    total, most = n.agg(F.sum("count"), F.max("count")).first()
    assert abs(total - 4000) < 250 and most >= 2


def test_principal_components_hold_the_variance(spark):
    rows = [([float(i), 2.0 * i, 0.01 * math.sin(i)],) for i in range(50)]
    got = mlprep.principal(spark.createDataFrame(rows, "v array<double>"), "v", 1).select("pca").collect()
    steps = {round(abs(b.pca[0] - a.pca[0]), 2) for a, b in zip(got, got[1:], strict=False)}
    assert steps == {round(math.sqrt(5), 2)}


def test_draw_by_a_uniform_number(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.3], u) for u in (0.0, 0.19, 0.2, 0.69, 0.7, 0.999)], "p array<double>, u double")
    assert [r[0] for r in df.select(mlprep.drawn(F.col("p"), F.col("u"))).collect()] == [0, 0, 1, 1, 2, 2]


def test_connected_groups_of_a_chain_and_a_hub(spark):
    edges = [(f"k{i:03}", f"k{i + 1:03}") for i in range(60)] + [("z", f"y{i}") for i in range(40)] + [("s", "s"), (None, "n")]
    got = {r["key"]: r["group"] for r in graph.connected(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert {v for k, v in got.items() if k[0] == "k"} == {"k000"} and {v for k, v in got.items() if k[0] in "yz"} == {"y0"}
    assert got["s"] == "s" and "n" not in got


def test_maps_and_nested_names(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}, [{"x": "u\t\tv\n"}])], "m map<string,string>, n map<string,string>, l array<struct<x:string>>")
    assert df.select(text.merged(F.col("m"), F.col("n"))).first()[0] == {"a": "1", "b": "3"}
    assert text.renamed(text.clean_items(df), {"l": "k", "x": "y"}).first().k[0].y == "u v"


def test_sequences_of_pairs_are_never_broadcast_by_an_estimate(spark):
    from catalink.plans import catalog

    plan = catalog.QUERIES["title_pair_sequences"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # Only the starts of numbered parts, of which there are as many as partitions.
    assert all("__part" in line for line in plan.splitlines() if "BroadcastHashJoin" in line)
