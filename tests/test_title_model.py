from catalink.operators import mlprep
from catalink.plans import catalog


def test_all_pairs_beyond_the_fitted_ones_are_judged(spark, monkeypatch):
    rows = [(f"a{i}", f"b{i}", i % 2) for i in range(60)]
    train, rest = mlprep.train_and_rest(spark.createDataFrame(rows, "a string, b string, label int"), 5, ["a", "b"])
    fitted, judged = ({(r.a, r.b) for r in x.collect()} for x in (train, rest))
    assert 0 < len(fitted) <= 10 and not fitted & judged
    assert fitted | judged == {r[:2] for r in rows}

    titles = [f"{a} {b} tranquille de la riviere" for a in ("maison", "montagne", "fontaine", "cuisine") for b in ("rouge", "verte", "bleue", "noire")]
    one = lambda n: spark.createDataFrame([(t,) for t in titles], f"{n} string")
    monkeypatch.setattr(catalog, "_titles", lambda s, d: (one("a"), one("b")))
    near = catalog.match.similar_texts(one("a"), one("b")).selectExpr("levenshtein(a, b) d").where("d <= 1 or d > 3").count()
    got = catalog.title_model(spark, "").first()
    # The fitted ones are at most four in five here, since all are fewer than the bound: the rest is what was left.
    assert 0 < got.tp + got.fp + got.tn + got.fn < near
