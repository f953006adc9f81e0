import itertools
import random

from pyspark.sql import functions as F

from catalink.llm import names


def linked(spark, rows):
    notices = spark.createDataFrame(rows, "auteur_key string, nom string, prenom string, annee_naissance string, lieu_naissance string")
    pages = spark.createDataFrame([], "author_key string, name string, url string, date_of_birth string, place_of_birth string")
    return {r.key: r.author for r in names.link_names(names.author_mentions(notices, pages)).collect()}


def test_hot_family_name_and_rare_given_name(spark):
    rows = [("z1", "Tremblay", "Z.", "1931", "Lac"), ("z2", "Tremblay", "Zenobie", "1931", "Lac"), ("z3", "Tremblay", "Zenobie", None, None)]
    rows += [("m1", "Tremblay", "Marie", "1950", "Nord"), ("m2", "Tremblay", "Marie Ursule", "1950", "Nord"), ("m3", "Roy", "Ursule", "1920", "Sud")]
    rows += [(f"t{i}", "Tremblay", f"{a}o{b}a", str(1800 + i), None) for i, (a, b) in enumerate(itertools.product("bdfgklnp", "lnrst"))]
    rows += [(f"q{i}", "Marie", f"{a}u{b}e", str(1800 + i), None) for i, (a, b) in enumerate(itertools.product("bdfg", "lnrs"))]
    got = linked(spark, rows)
    assert got["z1"] == got["z2"] == got["z3"]
    assert got["m1"] == got["m2"] != got["m3"]


def test_no_estimate_grows_with_the_steps(spark):
    notices = spark.createDataFrame([(f"t{i}", "Tremblay", given, "1931", None) for i, given in enumerate(("Z.", "Zenobie", "Marie", "M.", "Ursule"))], "auteur_key string, nom string, prenom string, annee_naissance string, lieu_naissance string")
    pages = spark.createDataFrame([], "author_key string, name string, url string, date_of_birth string, place_of_birth string")
    linked = names.link_names(names.author_mentions(notices, pages))
    assert len(str(linked._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 250


def test_names_meet_as_by_brute_force(spark):
    rnd = random.Random(3)
    full = ["tremblay"] * 6 + ["marie", "jean", "paul", "zenobie", "roy", "ursule", "lac", "nord"]
    made = {tuple(rnd.choice(full) if rnd.random() < 0.75 else rnd.choice("jmpzu") for _ in range(rnd.randint(1, 4))) for _ in range(150)}
    made = [[[t, *(["zenobie"] if t == "ursule" else [])] for t in m] for m in sorted(made)]
    df = spark.createDataFrame([(f"{i:03}", m) for i, m in enumerate(made)], "whole string, name array<array<string>>")
    met = {(int(r.a), int(r.b)) for r in names.meeting(names.name_keys(df)).collect()}
    fit = {(i, j) for i in range(len(made)) for j in range(i, len(made)) if names.fit_of(made[i], made[j]) is not None}
    assert fit and fit <= met


def test_second_initial_is_no_family_name():
    assert names.fit_of([["roy"], ["fabienne"], ["l"]], [["lac"], ["fabienne"]]) is None
    assert names.fit_of([["roy"], ["fabienne"], ["l"]], [["roy"], ["f"]]) is not None


def test_all_options_of_a_slip(spark):
    clean = ["marine", "karine", "carine", "farine", "darine", "narine", "sarine"]
    rows = [(f"k{i}{n}", [t, "roy"], [t, "roy"]) for i, t in enumerate(clean) for n in range(i + 1)] + [("x", ["zarine", "roy"], [])]
    df = spark.createDataFrame(rows, "key string, tokens array<string>, slug array<string>")
    got = {r.token: r.options for r in names._options(df).collect()}["zarine"]
    assert sorted(got) == sorted(clean)
    assert got[0] == "sarine"


def test_nicknames_are_learned_from_years_and_equal_initials_meet(spark):
    from pyspark.sql import functions as F

    rows = []
    for i, f in enumerate(("garmon", "belnois", "torvac", "quimbel", "sordane")):
        rows += [(f"a{i}", ["aurelie", f], ["aurelie", f], 1900 + i, None), (f"b{i}", [f, "lili"], [], 1900 + i, None)]
    rows += [(f"m{i}", ["aurelie", t], ["aurelie", t], 1800 + i, None) for i, t in enumerate(("dumas", "perrin", "lacour", "bertin"))]
    rows += [("i1", ["n", "jolgui"], [], 1956, None), ("i2", ["jolgui", "n"], [], 1956, "lac"), ("s1", ["chavgamuy", "lau"], [], 1914, "nord"), ("s2", ["laurence", "chavgamuy"], ["laurence", "chavgamuy"], 1914, None), ("e1", ["girrameau", "guy"], ["girrameau", "guy"], 1909, None), ("e2", ["guy", "girramo"], [], 1909, None)]
    df = spark.createDataFrame(rows, "key string, tokens array<string>, slug array<string>, year int, place string").withColumn("node", F.lit("clash"))
    got = {r.key: r.author for r in names.link_names(df).collect()}
    assert all(got[f"a{i}"] == got[f"b{i}"] for i in range(5)) and len({got[f"a{i}"] for i in range(5)}) == 5
    assert got["i1"] == got["i2"] and got["s1"] == got["s2"] and got["e1"] == got["e2"]


def test_assignment_is_optimal():
    rnd = random.Random(11)
    for _ in range(60):
        n, m = rnd.randint(1, 5), rnd.randint(5, 6)
        fit = [[rnd.choice((0.0, 0.0, 1.0, 2.0, 3.0)) for _ in range(m)] for _ in range(n)]
        best = max(sum(fit[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
        assert sum(fit[i][j] for i, j in enumerate(names.assignment(fit))) == best
    long = [[w] for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()]
    assert names.compare_names(long, long[::-1])[1] == 10


def test_a_kept_table_takes_less_disk_than_its_rows(spark):
    from pathlib import Path

    from catalink.runtime import cut, discard, shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = size()
    rows = spark.range(50_000).select("id", F.array(F.array(F.lit("tremblay")), F.array(F.lit("michel"))).alias("a name"), F.lit(None).cast("string").alias("place"))
    kept = cut(rows)
    assert 0 < size() - before < 50_000 * 16  # plain rows take 150 bytes each
    assert kept.schema.simpleString() == rows.schema.simpleString() and kept.count() == 50_000 == kept.distinct().count()
    discard(kept)
    assert size() <= before
