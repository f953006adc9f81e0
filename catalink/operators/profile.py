"""Profiling: counts and value frequencies of tables, nested items and graphs, descriptive statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def column_values(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(path, value, n, non_null): how often each value of each column occurs; empty texts are values.

    non_null is the column's count of values that are neither null nor empty. Columns are unpivoted in one
    scan. Nulls are counted as the value null.
    """
    columns = columns or rows.columns
    long = rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot([], columns, "path", "value")
    counted = long.groupBy("path", "value").agg(F.count("*").alias("n"))
    full = counted.groupBy("path").agg(F.sum(F.when(F.coalesce("value", F.lit("")) != "", F.col("n")).otherwise(0)).alias("non_null"))
    return counted.join(full, "path")


def top_values(frequencies: DataFrame, k: int = 10, most: int = 100) -> DataFrame:
    """The k most frequent values of each path; equal counts stand in order of the value, long values are cut to 75 places."""
    order = Window.partitionBy("path").orderBy(F.desc("n"), F.asc_nulls_first("value"))
    shown = F.when(F.length("value") > most, F.concat(F.substring("value", 1, 75), F.lit(".."))).otherwise(F.col("value"))
    return frequencies.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("value", shown)


def _leaves(schema: T.DataType, at: Column, path: str) -> list[tuple[str, Column]]:
    """(path, array of texts) for every text leaf under a value, lists flattened, structs descended into."""
    if isinstance(schema, T.StructType):
        return [x for f in schema.fields for x in _leaves(f.dataType, at.getField(f.name), f"{path}.{f.name}" if path else f.name)]
    if isinstance(schema, T.ArrayType):
        if isinstance(schema.elementType, T.StructType):
            # A field of an array of structs is the array of its values.
            return [x for f in schema.elementType.fields for x in _leaves(T.ArrayType(f.dataType), at.getField(f.name), f"{path}.{f.name}")]
        if isinstance(schema.elementType, T.ArrayType):
            return _leaves(schema.elementType, F.flatten(F.filter(at, lambda x: x.isNotNull())), path)
        return [(path, F.transform(at, lambda x: x.cast("string")))]
    return [(path, F.array(at.cast("string")))]


def nested_values(items: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(path, value, n): value frequencies of nested items; lists are flattened, structs give dotted paths, empty values are left out."""
    fields = [f for f in items.schema.fields if columns is None or f.name in columns]
    leaves = [x for f in fields for x in _leaves(f.dataType, F.col(f"`{f.name}`"), f.name)]

    def named(path: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.struct(F.lit(path).alias("path"), x.alias("value")))

    each = F.explode(F.flatten(F.array(*[named(p, v) for p, v in leaves])))
    return items.select(each.alias("x")).select("x.*").where("value <> ''").groupBy("path", "value").agg(F.count("*").alias("n"))


def path_counts(frequencies: DataFrame) -> DataFrame:
    """(path, total, distinct_values)"""
    return frequencies.groupBy("path").agg(F.sum("n").alias("total"), F.count("*").alias("distinct_values"))


def describe(rows: DataFrame, value: Column) -> DataFrame:
    """Count, nulls, mean, median, population deviation, maximum and smallest non-zero value, rounded to 6 places."""
    v = rows.select(value.cast("double").alias("v"))
    return v.agg(
        F.count("v").alias("n"),
        F.count_if(F.col("v").isNull()).alias("n_null"),
        F.round(F.avg("v"), 6).alias("mean"),
        F.round(F.median("v"), 6).alias("median"),
        F.round(F.stddev_pop("v"), 6).alias("pstdev"),
        F.max("v").alias("max"),
        F.min(F.when(F.col("v") > 0, F.col("v"))).alias("min_non_zero"),
    )


def histogram(rows: DataFrame, value: Column) -> DataFrame:
    """(value, n) in order of the value."""
    return rows.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy("value")


def extremes(rows: DataFrame, key: str, value: Column, k: int = 10) -> DataFrame:
    """The k rows with the largest and the k with the smallest non-zero value; ties in order of the key."""
    v = rows.select(F.col(key).alias("key"), value.alias("value")).where("value is not null")
    top = v.orderBy(F.desc("value"), "key").limit(k).withColumn("side", F.lit("top"))
    low = v.where("value > 0").orderBy("value", "key").limit(k).withColumn("side", F.lit("bottom"))
    return top.union(low)


def property_summary(rows: DataFrame, subject: str, prop: str) -> DataFrame:
    """(property, non_null_mean, nb_non_null, total): per property the mean count among subjects that have it."""
    counted = rows.where(F.col(prop).isNotNull()).groupBy(prop, subject).agg(F.count("*").alias("n"))
    return counted.groupBy(F.col(prop).alias("property")).agg(F.round(F.avg("n"), 6).alias("non_null_mean"), F.count("*").alias("nb_non_null"), F.sum("n").alias("total"))


def presence_counts(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """(combination, n): rows by the exact set of flags that hold; the names are joined by +."""
    name = F.concat_ws("+", *[F.when(c, F.lit(n)) for n, c in flags.items()])
    return rows.groupBy(name.alias("combination")).agg(F.count("*").alias("n"))


def homonyms(rows: DataFrame, name: str) -> DataFrame:
    """(name, n): names that more than one row carries."""
    return rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def list_sizes(rows: DataFrame, column: str) -> DataFrame:
    """(size, n): how many rows have lists of each size; null lists have size 0."""
    return rows.groupBy(F.coalesce(F.size(column), F.lit(0)).alias("size")).agg(F.count("*").alias("n"))


def paren_texts(rows: DataFrame, column: str) -> DataFrame:
    """(group, n): bracketed texts, counted once per distinct value of the column."""
    from catalink.functions.text import text_in_parens

    return rows.select(column).distinct().select(F.explode(text_in_parens(F.col(column))).alias("group")).groupBy("group").agg(F.count("*").alias("n"))


def graph_counts(triples: DataFrame, cls: str) -> tuple[DataFrame, DataFrame]:
    """Of the subjects with the class as an object: (p, n) per property and (p, o, n) per value."""
    members = triples.where(F.col("o") == cls).select("s").distinct()
    own = triples.join(members, "s", "left_semi").where(F.col("o") != cls)
    return own.groupBy("p").agg(F.count("*").alias("n")), own.groupBy("p", "o").agg(F.count("*").alias("n"))


def more_than(rows: DataFrame, column: str, sizes: tuple[int, ...], key: str) -> DataFrame:
    """(field, over, n, first): how many rows have lists of more than so many elements, and the smallest key among them."""
    each = rows.select(key, F.coalesce(F.when(F.col(column).isNotNull(), F.size(column)), F.lit(0)).alias("k"), F.explode(F.array(*[F.lit(x) for x in sizes])).alias("over")).where("k > over")
    return each.groupBy(F.lit(column).alias("field"), "over").agg(F.count("*").alias("n"), F.min(key).alias("first"))
