import random

import pytest
from pyspark.sql import functions as F

from catalink.operators import align, match

CASES = [
    ("les belles soeurs", "les belles soeurs", ["9782760900001"], ["978276090000#"], ["a"], [], "ISBN_TITRE_EQ"),
    ("abcdefgh", "abcdefxy", ["9782760900001"], ["9782760900001"], [], [], "ISBN_EQ_TITRE_DIFF"),
    ("abcdefgh", "zzzzzzzz", ["9782760900001"], ["9782760900001"], [], [], "ISBN_EQ_TITRE_T_DIFF"),
    ("abc", "abc", ["1"], ["2"], [], ["x y"], "ISBN_DIFF_TITRE_EQ"),
    ("abc", "abc", ["1"], ["2"], ["marie roy"], ["roy marie"], "ISBN_DIFF_TITRE_AUTEUR_EQ"),
    ("abc", "abc", ["1"], ["2"], ["a b"], ["c d"], "PAS_INFO"),
    ("abc", "abc", [], ["2"], ["marie roy"], ["roy m"], "TITRE_AUTEUR_EQ"),
    ("abc", "abc", [], ["2"], ["a b"], ["c d"], "TITRE_EQ_AUTEUR_DIFF"),
    ("abc", "abc", [], [], [], [], "TITRE_EQ"),
    (None, "abc", ["1"], ["1"], [], [], "PAS_INFO"),
    ("", "", [], [], [], [], "TITRE_EQ"),
    ("abcd", "abce", [], [], [], [], "PAS_INFO"),
]


@pytest.mark.parametrize("row", CASES)
def test_decision_table(spark, row):
    df = spark.createDataFrame([row[:6]], "t1 string, t2 string, i1 array<string>, i2 array<string>, a1 array<string>, a2 array<string>")
    assert df.select(match.case_of(*[F.col(c) for c in ("t1", "t2", "i1", "i2", "a1", "a2")])).first()[0] == row[6]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("k", [4, 6, 8])
def test_blocking_loses_nothing(spark, k):
    rnd = random.Random(k)
    base = ["".join(rnd.choice("abé ") for _ in range(rnd.randint(0, 24))) for _ in range(60)]
    for t in list(base):
        u = list(t)
        for _ in range(rnd.randint(1, 4)):
            if u and rnd.random() < 0.5:
                u.pop(rnd.randrange(len(u)))
            else:
                u.insert(rnd.randint(0, len(u)), rnd.choice("abé"))
        base.append("".join(u))
    texts = sorted(set(base))
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = {(r.a, r.b) for r in match.similar_texts(df, df, k).collect()}
    want = {(a, b) for a in texts for b in texts if distance(a, b) < max(1, min(len(a), len(b)) / k)}
    assert got == want


def test_segments_are_never_broadcast_by_an_estimate(spark):
    from catalink.plans import catalog

    near = match.similar_texts(*catalog._titles(spark, "/root/testdata/sf0.001"))
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()


def test_records_are_never_broadcast_by_an_estimate(spark):
    from catalink.plans import catalog

    linked = match.linked_pairs(catalog._books(spark, "/root/testdata/sf0.001"))
    assert "Broadcast" not in linked._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["author_confirmation", "written_title_tiers"])
def test_titles_of_names_are_never_broadcast_by_an_estimate(spark, name):
    from catalink.plans import catalog

    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_signatures_allow_all_near_texts(spark):
    rnd = random.Random(5)
    texts = []
    for _ in range(40):
        base = [rnd.choice("eaisdcé '-xyzk") for _ in range(rnd.choice((1, 2, 4, 9, 20, 37)))]
        texts.append("".join(base))
        # As many edits as are allowed, of one kind or mixed.
        for kinds in ("i", "d", "x", "idx"):
            u = list(base)
            for _ in range(max(1, -(-len(base) // 4) - 1)):
                kind, at = rnd.choice(kinds), rnd.randrange(len(u) or 1)
                if kind == "i" or not u:
                    u.insert(at, rnd.choice("qwœ"))
                elif kind == "d":
                    u.pop(at)
                else:
                    u[at] = rnd.choice("qwœ")
            texts.append("".join(u))
    texts = sorted(set(texts))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = {(a, b) for a in texts for b in texts if distance(a, b) < max(1, min(len(a), len(b)) / 4)}
    assert {(r.a, r.b) for r in match.similar_texts(df, df).collect()} == want
    assert {(r.a, r.b) for r in match.similar_texts(df).collect()} == want


def test_symmetric_pairs_are_twice_as_many(spark):
    d = "/root/testdata/sf0.001"
    books = match.library_books(spark.read.parquet(d + "/livre.parquet"), spark.read.parquet(d + "/babelio_book.parquet"))
    once, twice = match.linked_pairs(books), match.linked_pairs(books, symmetric=True)
    assert twice.count() == 2 * once.count() > 0
    assert once.where("data_base1 = data_base2").count() == 0
    flat = match.flat_couples(once)
    assert len(flat.columns) == 18


def test_invalid_records_are_left_out(spark):
    rows = spark.createDataFrame([(None, None, None), ("1", "t", ["x"])], "i string, t string, a array<string>")
    made = match.book(rows, F.col("i"), F.lit("s"), F.col("t"), F.col("a"), F.array(F.lit("1;2")), split_multi=True)
    assert [r.id for r in match.valid(made).collect()] == ["1"]
    assert match.valid(made).first().isbns == ["1", "2"]


def test_confirmation(spark):
    rows = spark.createDataFrame([(["le lac"], ["le lac"]), (["le lac"], ["xx"]), ([], ["xx"]), (["a"], [])], "o array<string>, t array<string>")
    assert [r[0] for r in rows.select(match.confirmation(F.col("o"), F.col("t"))).collect()] == ["confirmed", "infirmed", "unsure", "unsure"]
    raw = spark.createDataFrame([(["le lac"], ["zz"], ["Sur Le Lac (roman)"])], "o array<string>, t array<string>, r array<string>")
    assert raw.select(match.confirmation(F.col("o"), F.col("t"), F.col("r"))).first()[0] == "confirmed"


@pytest.mark.parametrize(("present", "kept"), [("ae", False), ("ac", True), ("ace", False), ("abc", True), ("abcde", True), ("a", False)])
def test_parity(spark, present, kept):
    row = [("k", *[s if s in present else None for s in "abcde"])]
    df = spark.createDataFrame(row, "isbn string, adp string, ile string, depot string, hurtubise string, babelio string")
    assert bool(align.overlapping(df, "parity").count()) == kept
    assert bool(align.overlapping(df, "any_overlap").count()) == (len(present) > 1)


def test_alignment_lines(spark):
    df = spark.createDataFrame([("1", "x", None, None, None, "y")], "isbn string, adp string, ile string, depot string, hurtubise string, babelio string")
    assert align.alignment_lines(df).first()[0] == "1, x, , , , y"
    assert [tuple(r) for r in align.positive_pairs(df).collect()] == [("1", "x", "y")]


def test_baseline(spark):
    df = spark.createDataFrame([("Le lac", "le lac bleu"), ("abc", "xyz")], "a string, b string")
    assert [r[0] for r in df.select(match.baseline_same(F.col("a"), F.col("b"))).collect()] == [True, False]


def test_examples_of_every_threshold(spark):
    rnd = random.Random(3)
    a = {"".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 16))) for _ in range(60)}
    b = {"".join(x if rnd.random() < 0.8 else rnd.choice("xyz") for x in t) + rnd.choice(("", "", "z")) for t in a}
    left, right = (spark.createDataFrame([(t,) for t in sorted(x)], "t string") for x in (a, b))
    want = {}
    for t in range(2, 10):
        met = [(x, y) for x in a for y in b if 0 < distance(x, y) and distance(x, y) * t == min(len(x), len(y))]
        if met:
            want[t] = min(met)
    assert {2, 3, 4} <= set(want)
    for batch in (4, 256):
        got = match.threshold_examples(left, right, batch=batch).collect()
        assert {r.threshold: (r.a, r.b) for r in got} == want and len(got) == len(want)
