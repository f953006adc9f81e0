import pytest
from pyspark.sql import functions as F

from catalink.llm.canonical import canonical_text, folded_words, not_canonical

CASES = [
    ("ｄéｂｕｔ １９", "début 19"),
    ("été ça", "été ça"),
    ("l‍été­﻿", "lété"),
    ("À la mer　", "À la mer "),
    ("ﬁn ﬂot", "fin flot"),
    ("lа ріèce", "la pièce"),
    ("Οn rοman", "On roman"),
    ("Lօrⅽhⅰⅼanԁe", "Lorchilande"),
    ("Saint‐Luc a‑b", "Saint-Luc a-b"),
    ("𝐁𝐨𝐧 ａ＇b", "Bon a'b"),
]
KEPT = ["Вечерняя звезда", "λόγος", "ὕμνος", "H₂O, m² et ½", "1ʳᵉ édition — n° 7", "« l’œuf », ‘x’ “y” – z", "日本", "naïve\nÆgir\tß", "", "мир"]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_repaired(spark, text, expected):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert canonical_text(df).first().canonical == expected
    assert not_canonical(df).count() == 1


def test_kept(spark):
    df = spark.createDataFrame(list(enumerate(KEPT)), "doc_id bigint, text string")
    assert not_canonical(df).count() == 0


def test_stable_over_documents(spark):
    df = canonical_text(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), keep=["doc_id"])
    again = canonical_text(df.withColumnRenamed("canonical", "text"))
    assert again.where(F.col("text") != F.col("canonical")).count() == 0


def test_odd_tables(spark):
    rows = [(1, None, "a"), (1, "x" * 500_000 + "ａ", "b"), (2, "x" * 500_000 + "ａ", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, canonical string")
    got = canonical_text(df).collect()
    assert [r.canonical is None for r in got] == [True, False, False]
    assert got[1].canonical.endswith("xa") and len(got[1].canonical) == 500_001
    assert canonical_text(df.limit(0)).count() == 0
    assert folded_words(df.where("text is null")).first().words == []
    assert folded_words(spark.createDataFrame([("L’ŒUF ÉTÉ-là 2",)], "text string")).first().words == ["l", "oeuf", "ete", "la", "2"]
