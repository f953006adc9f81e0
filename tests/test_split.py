import pytest

from catalink.operators.split import infer_delimiters, split_values, values_of


@pytest.mark.parametrize(
    ("kind", "delimiters", "text", "values"),
    [
        ("inverted name", ("semicolon",), ' Roy, A ; "Lac, B ; ill." ;; «Côté, C»', ["Roy, A", "Lac, B ; ill.", "Côté, C"]),
        ("inverted name", ("semicolon",), '"Roy, Ann ""Annie"""', ['Roy, Ann "Annie"']),
        ("inverted name", ("semicolon",), 'Roy "A', ['Roy "A']),
        ("contributor", ("comma",), "A B (Texte de, avec C),Collectif (De (auteur)),", ["A B (Texte de, avec C)", "Collectif (De (auteur))"]),
        ("isbn", ("words", "comma"), "978 2 16359 438 8 9782505009619,220257059X (v. 1, rel.)", ["978 2 16359 438 8", "9782505009619", "220257059X (v. 1, rel.)"]),
        ("isbn", ("words",), "978 2 16359 438 8", ["978 2 16359 438 8"]),
        ("isbn", (), "", []),
        ("isbn", (), None, []),
    ],
)
def test_values(kind, delimiters, text, values):
    assert values_of(text, kind, delimiters) == values


def test_split_whole_and_odd_fields(spark):
    many = ";".join(f"Nom{i}, Prénom" for i in range(20_000))
    rows = [(1, "a", many, "x"), (1, "a", "Roy, A;Lac, B", "x"), (2, None, None, None), (3, None, "  ", None), (4, None, "(" * 5000 + "Roy, A", None)]
    df = spark.createDataFrame(rows, "k bigint, s string, f string, valeur string")
    got = split_values(df, "k", "s", "f", "inverted name").collect()
    assert sum(r.k == 1 for r in got) == 20_002
    assert max(r.rang for r in got if r.k == 1) == 20_000
    assert {r.k for r in got} == {1, 4}
    assert split_values(df.limit(0), "k", "s", "f", "inverted name").count() == 0


def test_delimiters_follow_the_source(spark):
    rows = [(i, "p", "Roy, A|Lac, B") for i in range(30)] + [(i, "q", "Roy, A;Lac, B") for i in range(30)]
    df = spark.createDataFrame(rows, "k bigint, s string, f string")
    found = {r.src: r.delimiters for r in infer_delimiters(df, "s", "f", "inverted name").collect()}
    assert "bar" in found["p"] and "semicolon" in found["q"]
    assert "comma" not in found["p"]


def test_score_needs_both_regular_pieces_and_consistent_numbers(spark):
    # Every piece but one in ten is regular, yet hardly any row has as many pieces as values.
    rows = [(f"r{i}", "s", " ; ".join(["Roy, Marie"] * 9 + ["x"])) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, s string, t string")
    assert infer_delimiters(df, "s", "t", "inverted name").first().delimiters == []
    assert values_of(" 9782736971904/9782527295285/ ", "isbn", ("slash",)) == ["9782736971904", "9782527295285"]
