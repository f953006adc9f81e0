"""Streams of landed crawl files: reading, dropping repeats, counting by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def landed(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """A stream of JSON lines as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def first_seen(stream: DataFrame, key: str, at: str, lateness: str = "1 day") -> DataFrame:
    """Items once per key as long as repeats come within the lateness; state is kept no longer."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark([key])


def per_window(stream: DataFrame, at: str, by: str, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """(start, by, n): items per tumbling window; later ones than the lateness are left out."""
    counted = stream.withWatermark(at, lateness).groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), by, "n")
