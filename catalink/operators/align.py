"""Alignment of sources by ISBN, overlap and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalink.functions import text

SOURCES = ("adp", "ile", "depot", "hurtubise", "babelio")


def isbn_titles(books: DataFrame, drop_blank: bool = False) -> DataFrame:
    """(isbn, data_base, title): alignment keys of all books, one title per key and source (the last by text).

    Blank ISBNs fall together on the key X unless drop_blank.
    """
    each = books.select("data_base", text.fix_mojibake(F.col("title_raw"), "alignment").alias("title"), F.explode(F.when(F.size("isbns_raw") > 0, F.col("isbns_raw")).otherwise(F.array(F.lit("")))).alias("raw"))
    keyed = each.select(text.format_isbn(text.strip_parens(F.col("raw"))).alias("isbn"), "data_base", "title")
    if drop_blank:
        keyed = keyed.where("isbn <> 'X'")
    return keyed.groupBy("isbn", "data_base").agg(F.max("title").alias("title"))


def align(titles: DataFrame, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """One row per ISBN with the title in each source, null where a source lacks it: one shuffle for all sources."""
    return titles.groupBy("isbn").agg(*[F.max(F.when(F.col("data_base") == s, F.col("title"))).alias(s) for s in sources])


def degree(sources: tuple[str, ...] = SOURCES) -> Column:
    """In how many sources an aligned row is present."""
    total = F.lit(0)
    for s in sources:
        total = total + F.col(s).isNotNull().cast("int")
    return total


def overlapping(aligned: DataFrame, mode: str = "parity", sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """Aligned rows that count as shared.

    any_overlap keeps what is in two sources or more. parity keeps what lies in an odd number of the nine
    pairwise intersections (the pair of the first and last source is not among them).
    """
    n = degree(sources)
    if mode == "any_overlap":
        return aligned.where(n >= 2)
    pairs = n * (n - 1) / 2 - (F.col(sources[0]).isNotNull() & F.col(sources[-1]).isNotNull()).cast("int")
    return aligned.where(F.pmod(pairs.cast("int"), F.lit(2)) == 1)


def coverage(aligned: DataFrame, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """(source, n): how many aligned ISBNs each source has."""
    return aligned.agg(*[F.count(s).alias(s) for s in sources]).unpivot([], list(sources), "source", "n")


def degrees(aligned: DataFrame, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """(n_sources, n): how many ISBNs are in so many sources."""
    return aligned.groupBy(degree(sources).alias("n_sources")).agg(F.count("*").alias("n"))


def intersections(titles: DataFrame) -> DataFrame:
    """(source1, source2, n): shared keys of each pair of sources."""
    a = titles.select("isbn", F.col("data_base").alias("source1"))
    b = titles.select("isbn", F.col("data_base").alias("source2"))
    return a.join(b, "isbn").where("source1 < source2").groupBy("source1", "source2").agg(F.count("*").alias("n"))


def combinations(aligned: DataFrame, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """(sources, n): how many ISBNs are in exactly this set of sources, by one cube-free pass over flags."""
    name = F.concat_ws("+", *[F.when(F.col(s).isNotNull(), F.lit(s)) for s in sources])
    return aligned.groupBy(name.alias("sources")).agg(F.count("*").alias("n"))


def positive_pairs(aligned: DataFrame, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """(isbn, title1, title2): the 2-combinations of distinct titles that share an ISBN."""
    titles = F.array_sort(F.array_distinct(F.filter(F.array(*sources), lambda x: x.isNotNull())))
    every = aligned.select("isbn", titles.alias("t")).where(F.size("t") > 1)
    first = every.select("isbn", "t", F.posexplode("t").alias("i", "title1"))
    return first.select("isbn", "title1", F.explode(F.slice("t", F.col("i") + 2, F.size("t"))).alias("title2"))


def alignment_lines(aligned: DataFrame, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """Lines of the hand-formatted alignment file."""
    return aligned.select(F.concat_ws(", ", "isbn", *[F.coalesce(s, F.lit("")) for s in sources]).alias("value"))
