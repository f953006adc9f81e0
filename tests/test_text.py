import pytest
from pyspark.sql import functions as F

from catalink.functions import text
from catalink.functions.fold import fold, words


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("2-89006-591-X", "978289006591X"),
        ("978-2-89006-591-3 (br.)", "9782890065913"),
        ("289006591", "289006591"),
        ("289006591X | 2890065912", "289006591X2890065912"),
        (" isbn : 123456789X", "978123456789X"),
        ("123456789012", "123456789012#"),
        (None, None),
        ("", ""),
    ],
)
def test_normalize_isbn(spark, value, expected):
    assert one(spark, text.normalize_isbn, value) == expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [("289006591X", "978289006591X"), ("9872890065913", "987289006591X"), ("987289006591X", "987289006591X"), ("2890065912", "978289006591X"), ("292088736X (br.)", "978292088736X"), ("", "X")],
)
def test_format_isbn(spark, value, expected):
    assert one(spark, text.format_isbn, value) == expected


def test_normalize(spark):
    assert one(spark, text.normalize, "été-là, œuvre!") == "ete-la oeuvre"
    assert one(spark, text.normalize, "a (b (c) d) e (") == "a e"
    assert one(spark, text.normalize, "L'Ã©tÃ©  du lac") == "l ete du lac"
    assert one(spark, text.normalize, None) is None
    assert one(spark, text.normalize, "") == ""


def test_normalize_author_joins_neighbours(spark):
    assert one(spark, text.normalize_author, "a dupont b jean c") == "dupontjean"


def test_mojibake_variants(spark):
    assert one(spark, text.fix_mojibake, "lâ\x80\x99Ã©tÃ©") == "l’été"
    assert one(spark, lambda c: text.fix_mojibake(c, "alignment"), "ã‰tÃ¨") == "â‰tê"


def test_parens(spark):
    assert one(spark, lambda c: text.text_in_parens(c), "x (a) y (b (c))") == ["(a)", "(c)"]
    assert one(spark, lambda c: text.text_in_parens(c, first_only=True), "x (a) y (b (c))") == ["(a)", "(b )"]


def test_names_and_titles(spark):
    assert one(spark, text.swap_name, "Roy, Marie") == "Marie Roy"
    assert one(spark, text.swap_name, "Marie Roy ") == "Marie Roy"
    assert one(spark, text.title_case, "JEAN-PAUL D'ORLÉANS  roy") == "Jean-Paul D'Orléans roy"
    assert one(spark, text.main_title, "Le lac : récit / par X") == "Le lac"
    assert one(spark, text.uri_tail, "http://a/b/c/") == "c"
    assert one(spark, text.before_paren, "Marie Roy (écrivaine)") == "Marie Roy"


def test_contributors(spark):
    assert one(spark, text.contributor_name, " Marie Roy (Traduit par) ") == "Marie Roy"
    assert one(spark, text.contributor_role, "Marie Roy (De (auteur))") == "(De (auteur))"
    assert one(spark, text.contributor_name, "Marie Roy") == ""
    assert one(spark, lambda c: text.role_property(text.contributor_role(c)), "X (Traduit par)") == "http://schema.org/translator"


def test_work_info(spark):
    rows = spark.createDataFrame([(["Le lac (1980)", "roman", ", Québec : Givre", "ISBN : 2890065912"],)], "l array<string>")
    got = rows.select(*[v.alias(k) for k, v in text.work_info(F.col("l")).items()]).first().asDict()
    assert got == {"title": "Le lac", "year": "1980", "place": "Québec", "publisher": "Givre", "isbn": "2890065912"}


def test_fold(spark):
    assert one(spark, fold, "ÉTÉ Œuf é") == "ete oeuf e"
    assert one(spark, words, "L'été, 2 fois") == ["l", "ete", "2", "fois"]
    assert one(spark, words, None) == []


def test_small_functions(spark):
    assert one(spark, text.bio_text, "Notice biographique\nNée") == "Née"
    assert one(spark, text.bare_place, " [Québec] ") == "Québec"
    assert one(spark, text.isbn_path, "9782890065913") == "9782/890/065/913"
    assert one(spark, text.clean_blanks, "a\t\tb\nc") == "a bc"
    assert one(spark, lambda c: text.lookup(c, text.ONIX_CODES["product form"]), "BC") == "Paperback / softback"
    assert one(spark, text.normalize_alignment, " «Été, là!» ") == "Été là"
