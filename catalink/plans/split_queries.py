"""Queries on packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalink.operators.split import infer_delimiters, split_values
from catalink.runtime import read

#: (table, source column, field, kind of its values)
FIELDS = (
    ("depotlegal20171231", "code_editeur", "liste_auteur", "inverted name"),
    ("depotlegal20171231", "code_editeur", "liste_isbn_nettoye", "isbn"),
    ("exportation_hurtubise", "editeur", "contributeurs", "contributor"),
)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        split_values(read(spark, d, t), "no_ligne", s, f, k).select(F.lit(t).alias("table_name"), "no_ligne", F.lit(f).alias("field_name"), "rang", "valeur")
        for t, s, f, k in FIELDS
    ]
    return parts[0].union(parts[1]).union(parts[2])


def p6_delimiters(spark: SparkSession, d: str) -> DataFrame:
    """The delimiters found for each source of each field."""
    parts = [infer_delimiters(read(spark, d, t), s, f, k).select(F.lit(t).alias("table_name"), F.lit(f).alias("field_name"), F.col("src").alias("source"), F.array_join("delimiters", " ").alias("delimiters")) for t, s, f, k in FIELDS]
    return parts[0].union(parts[1]).union(parts[2])


QUERIES = {"p6_found": p6_found, "p6_delimiters": p6_delimiters}

_ISBN = r"(?:97[89](?:[- ]?\d){9}[- ]?[\dXx]|\d(?:[- ]?\d){8}[- ]?[\dXx])(?:\s*\([^()]*\))?"
_PARTS = r"""(?:"(?:[^"]|"")*"|«[^»]*»|\((?:[^()]|\([^()]*\))*\)|[^{}])+"""

#: The same by fixed delimiters of each field, for comparison.
SQL = {
    "p6_found": rf"""
WITH a AS (SELECT 'depotlegal20171231' t, 'liste_auteur' f, no_ligne, regexp_extract_all(replace(liste_auteur, '//', ';'), '{_PARTS.format(r";|\t\r\n")}') l FROM depotlegal20171231
  UNION ALL SELECT 'depotlegal20171231', 'liste_isbn_nettoye', no_ligne, regexp_extract_all(liste_isbn_nettoye, '{_ISBN}') FROM depotlegal20171231
  UNION ALL SELECT 'exportation_hurtubise', 'contributeurs', no_ligne, regexp_extract_all(regexp_replace(contributeurs, '(^|\s)/(\s|$)', ';', 'g'), '{_PARTS.format(r";,|\t\r\n")}') FROM exportation_hurtubise),
b AS (SELECT t, f, no_ligne, list_filter(list_transform(l, lambda x: trim(
    CASE WHEN regexp_full_match(trim(x), '"(?:[^"]|"")*"') THEN replace(trim(x)[2:-2], '""', '"') WHEN regexp_full_match(trim(x), '«[^»]*»') THEN trim(x)[2:-2] ELSE x END)), lambda x: x <> '') l FROM a)
SELECT t AS table_name, no_ligne, f AS field_name, CAST(generate_subscripts(l, 1) AS INT) rang, unnest(l) valeur FROM b"""
}
