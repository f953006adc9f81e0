import random

import pytest
from pyspark.sql import functions as F

from catalink.llm import components as components_
from catalink.llm.components import components
from catalink.llm.fusion import claims, discover, edition_day, editor_name, page_count, single_year


def union_find(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        for x in (a, b):
            if x:
                root(x)
        if a and b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {x: root(x) for x in up}


@pytest.mark.parametrize("last", [0, 50_000])
@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components_equal_union_find(spark, shape, last):
    rnd = random.Random(1)
    if shape == "chain":
        pairs = [(f"k{i:03}", f"k{i + 1:03}") for i in range(150)]
    elif shape == "star":
        pairs = [("hub", f"k{i:03}") for i in range(300)] + [(f"x{i}", f"x{i}") for i in range(3)]
    else:
        pairs = [(f"k{rnd.randint(0, 300)}", f"w{rnd.randint(0, 300)}") for _ in range(250)]
    pairs += pairs[:20] + [(None, "alone"), ("lone", None), (None, None), ("", "empty")]
    rnd.shuffle(pairs)
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("key", F.lit("clash")).repartition(5)
    got = components(df, "a", "b", last=last).collect()
    assert {r.key: r.group_key for r in got} == union_find(pairs)
    assert len(got) == len({r.key for r in got})


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def value(spark, column, *row):
    kinds = "x string, t timestamp_ntz"
    import datetime

    at = datetime.datetime(2020, 5, 3)
    return spark.createDataFrame([(row[0], at)], kinds).select(column(F.col("x"), F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("column", "text", "usable"),
    [
        (edition_day, "31/02/2001", False), (edition_day, "29/02/2000", True), (edition_day, "05/2020", True), (edition_day, "06/2020", False), (edition_day, "2020", True), (edition_day, "2021", False),
        (edition_day, "0000", False), (edition_day, "13/2001", False), (edition_day, "bientôt", False), (edition_day, None, False), (edition_day, "04/05/2020", False), (edition_day, " 1999 ", True),
        (single_year, "c1957", True), (single_year, "[19..]", False), (single_year, "19--", False), (single_year, "1499", False), (single_year, "2021", False), (single_year, "DL 1993", True), (single_year, "1990-1991", False), (single_year, "197", False), (single_year, "", False),
    ],
)
def test_usable_dates(spark, column, text, usable):
    assert (value(spark, column, text) is not None) == usable


@pytest.mark.parametrize(
    ("column", "text", "usable"),
    [
        (page_count, "0", False), (page_count, "5000", True), (page_count, "5001", False), (page_count, " 312 p.", True), (page_count, "12p", True), (page_count, "-1", False), (page_count, "pages", False), (page_count, "999999999999", False), (page_count, None, False),
        (editor_name, "L'Outarde", True), (editor_name, "[sans éditeur]", False), (editor_name, "éditeur inconnu", False), (editor_name, "123", False), (editor_name, "...", False), (editor_name, "xxx", False), (editor_name, "A compléter", False), (editor_name, "n/a", False), (editor_name, "s.n.", False), (editor_name, "Non renseigné", False),
    ],
)
def test_usable_names_and_counts(spark, column, text, usable):
    assert (value(spark, lambda x, t: column(x), text) is not None) == usable


def said(spark, rows):
    df = spark.createDataFrame(rows, "g string, id bigint, s string, v string, at timestamp_ntz, value string")
    return claims(df, "e", "g", "id", "at", "s", {"f": F.col("v")})


def test_newest_usable_row_wins(spark):
    from datetime import datetime as t

    rows = [("a", 1, "s", "x", t(2020, 1, 1), ""), ("a", 2, "s", "y", t(2020, 1, 2), ""), ("a", 4, "r", "z", t(2020, 1, 2), ""), ("a", 3, "s", None, t(2020, 1, 3), ""), ("b", 5, "s", "x", t(2020, 1, 1), ""), ("c", 6, "s", None, t(2020, 1, 1), ""), ("c", 7, "s", None, None, ""), (None, 8, "s", "x", t(2020, 1, 1), ""), ("d", 9, None, "x", None, ""), ("d", 9, None, "x", None, "")]
    got = {r.group_key: (r.rec_id, r.value) for r in discover(said(spark, rows)).collect()}
    assert got == {"a": (2, "y"), "d": (9, "x")}
    assert discover(said(spark, rows).limit(0)).count() == 0


def test_votes_find_the_reliable_source(spark):
    from datetime import datetime as t

    rows, n = [], 0
    for g in range(40):
        for s, v in (("good", "true"), ("fair", "true" if g % 3 else "odd"), ("bad", f"wrong{g}")):
            n += 1
            rows.append((f"g{g}", n, s, v, t(2020, 1, 1 + (s == "bad")), ""))
    votes = {r.group_key: r.value for r in discover(said(spark, rows), prior=None).collect()}
    assert sum(v == "true" for v in votes.values()) == 40
    newest = {r.value for r in discover(said(spark, rows)).collect()}
    assert all(v.startswith("wrong") for v in newest)


def test_links_fall_by_a_constant_factor_a_level(spark):
    n = 100_000
    edges = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(8).cache()
    left = [n]
    for level in range(3):
        clusters = components_.decompose(edges, level).cache()
        edges = components_.between(edges, clusters).cache()
        left.append(edges.count())
    assert all(after < 0.6 * before for before, after in zip(left, left[1:], strict=False))


def test_labels_rest_and_hubs_are_met_in_parts(spark):
    rows = [(0, i) for i in range(1, 400)] + [(i, i + 400) for i in range(1, 400)]
    edges = spark.createDataFrame(rows, "a long, b long").cache()
    plain = {tuple(r) for r in components_.decompose(edges, 0).collect()}
    assert plain == {tuple(r) for r in components_.decompose(edges, 0, hub=100).collect()}
    # Brute force: hops less head start, over all centres.
    starts = {r.v: r.s for r in spark.range(800).select(F.col("id").alias("v"), components_.head_start(F.col("id"), 0, components_.RATE, components_.LONGEST).alias("s")).collect()}
    near = {}
    for a, b in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for v, c in plain:
        hops, seen, edge = {v: 0}, {v}, [v]
        while edge:
            edge = [w for u in edge for w in near[u] if w not in seen and not seen.add(w) and not hops.update({w: hops[u] + 1})]
        assert c == min(hops, key=lambda w: (hops[w] - starts[w], w))


def test_rounds_lead_from_the_majority_to_the_newest(spark, same_as_sql):
    from catalink.llm.fusion import book_claims
    from catalink.llm.sql import SQL
    from catalink.runtime import read

    d = "/root/testdata/sf0.01"
    made = book_claims(read(spark, d, "babelio_book"), read(spark, d, "livre"))
    keys = ["entity", "group_key", "field_name", "rec_id"]
    same_as_sql(discover(made).select(*keys), SQL["p1_found"], d)
    with pytest.raises(AssertionError):
        same_as_sql(discover(made, rounds=0).select(*keys), SQL["p1_found"], d)


def test_rounds_start_from_the_prior_and_decide_on_supports(spark, monkeypatch):
    from datetime import datetime as t

    from catalink.llm import fusion

    trusts = []
    monkeypatch.setattr(fusion, "cut", lambda df, real=fusion.cut: trusts.append(df) or real(df) if "wrong" in df.columns else real(df))
    rows = [(f"g{g}", 3 * g + i, s, "true" if i or g % 4 else "odd", t(2020, 1, 3 - i), "") for g in range(12) for i, s in enumerate("abc")]
    got = {r.group_key: (r.value, r.support) for r in discover(said(spark, rows)).collect()}
    assert {g for g, (v, _) in got.items() if v == "odd"} == {"g0", "g4", "g8"}
    start = {(r.age, r.wrong) for r in trusts[0].collect()}
    assert start == set(fusion.AGE_PRIOR.items())
    # Nothing that was estimated is thrown away: one round moves, the next finds it at rest.
    assert len(trusts) == 3
    prior = {r.age: r.wrong for r in trusts[0].collect()}
    import math

    alone = math.log(prior["newest"]) / (math.log(prior["newest"]) + 2 * math.log(prior["older"]))
    assert abs(got["g0"][1] - alone) > 0.01


def test_no_estimate_grows_with_the_levels(spark):
    pairs = spark.createDataFrame([(f"k{i:03}", f"k{i + 1:03}") for i in range(300)], "a string, b string")
    got = components(pairs, "a", "b", last=0)
    assert len(str(got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 100
    assert {(r.key, r.group_key) for r in got.collect()} == {(f"k{i:03}", "k000") for i in range(301)}


def test_files_that_nothing_reads_are_gone(spark):
    from pathlib import Path

    from catalink.runtime import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("part-*"))
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: sum(x.rpartition("/")[2].startswith("shuffle_") for x in blocks.getAllFiles().mkString("\n").split("\n"))
    pairs = spark.range(20_000).select(F.format_string("k%07d", "id").alias("a"), F.format_string("k%07d", (F.col("id") / 3).cast("long")).alias("b")).repartition(4)
    before, files = size(), shuffles()
    got = components(pairs, "a", "b", last=0)
    # Keys, clusters and named vertices stay; pairs and the links of each level are gone.
    assert size() - before < 45 * 20_000
    assert shuffles() - files < 20
    assert got.select("group_key").distinct().count() == 1
