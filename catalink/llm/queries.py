"""Queries of this subpackage by name; each takes a session and the folder of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalink.llm import canonical, components, encoding, fusion, leak, linkage, mix, names
from catalink.llm.sql import SQL
from catalink.runtime import read

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    said = fusion.book_claims(read(spark, d, "babelio_book"), read(spark, d, "livre"))
    return fusion.discover(said).select("entity", "group_key", "field_name", "rec_id")


def p1_survivors(spark: SparkSession, d: str) -> DataFrame:
    """One surviving record per page or notice, built field by field from the claims alone."""
    said = fusion.book_claims(read(spark, d, "babelio_book"), read(spark, d, "livre"))
    best = fusion.discover(said, prior=None)
    fields = ["editor", "edition_date", "nb_pages", "annee"]
    return best.groupBy("entity", "group_key").agg(*[F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in fields])


def _restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restore(encoding.library_texts(read(spark, d, "livre"), read(spark, d, "babelio_book"), read(spark, d, "babelio_author")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _restored(spark, d).select("entity", "row_key")


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    return _restored(spark, d)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return components.components(read(spark, d, "couple_writers"), "author_db.author_key", "author_wiki.author_key").select(F.col("key").alias("author_key"), "group_key")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.name_pairs(names.link_names(names.author_mentions(read(spark, d, "auteur"), read(spark, d, "babelio_author"))))


def _books(spark: SparkSession, d: str) -> DataFrame:
    return linkage.link_books(*linkage.book_records(read(spark, d, "babelio_book"), read(spark, d, "livre")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return linkage.same_books(_books(spark, d)).select("url", "notice")


def p5_matches(spark: SparkSession, d: str) -> DataFrame:
    """All compared pairs with their levels of agreement and the confidence of a match."""
    return _books(spark, d)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks(read(spark, d, "documents"), read(spark, d, "eval_item")).where("exact").select("doc_id", "item_id")


def p7_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Leaks with up to two exchanged words in twelve."""
    return leak.leaks(read(spark, d, "documents"), read(spark, d, "eval_item"), tolerated=2)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(read(spark, d, "documents"), read(spark, d, "mix_target"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    chosen, shares = mix.mix(read(spark, d, "documents"), read(spark, d, "mix_target"))
    return shares.withColumns({c: F.round(c, 6) for c in ("target_share", "reached_share")})


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.not_canonical(read(spark, d, "documents"))


def p9_canonical(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonical_text(read(spark, d, "documents"), keep=["doc_id"])


def queries() -> dict[str, Query]:
    return {n: f for n, f in globals().items() if n[:1] == "p" and n[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, s in SQL.items() if n in queries()}
