"""Evaluation passages inside training text: spaced-seed hashing and verification around the hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalink.llm.canonical import folded_words
from catalink.runtime import broadcast_if_small, cut

SPAN = 12
#: Fixed masks over a window of 12 words; words at a 0 are ignored. The places fall into four classes and each mask
#: ignores two of them, so of any two places some mask ignores both.
MASKS = tuple("".join("0" if k % 4 in (x, y) else "1" for k in range(SPAN)) for x in range(4) for y in range(x))


def _windows(words: Column, masks: tuple[str, ...]) -> Column:
    """One struct (mask, at, seed) for each mask and each window of SPAN words; at counts from 1."""

    def of(mask: str, number: int) -> Column:
        taken = [k for k, bit in enumerate(mask) if bit == "1"]
        return F.transform(
            F.when(F.size(words) >= SPAN, F.sequence(F.lit(1), F.size(words) - SPAN + 1)).otherwise(F.array().cast("array<int>")),
            lambda i: F.struct(F.lit(number).alias("mask"), i.alias("at"), F.xxhash64(*[F.get(words, i + (k - 1)) for k in taken]).alias("seed")),
        )

    return F.concat(*[of(m, n) for n, m in enumerate(masks)])


def seed_hits(documents: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, at, item_at, same): windows of documents and items that agree under a mask.

    same tells for each of the 12 positions whether the words are equal there. All windows of all texts
    take part. Seeds are joined as numbers; words are brought back for hits only. The seeds of the items are
    broadcast only where they are measured to take at most broadcast_bytes; a larger evaluation set is joined by
    shuffle. Texts of fewer than 12 words, empty and null texts have no window. Repeated rows give repeated hits.
    """
    asked = cut(folded_words(items, "text", "item_words", ["item_id"]))
    seeds = cut(asked.select("item_id", F.explode(_windows(F.col("item_words"), masks)).alias("w")).select("item_id", "w.mask", "w.seed", F.col("w.at").alias("item_at")))
    near = broadcast_if_small(seeds, broadcast_bytes)
    texts = folded_words(documents, "text", "words", ["doc_id"])
    corpus = texts.select("doc_id", "words", F.explode(_windows(F.col("words"), masks)).alias("w"))
    if near is seeds:
        hits = corpus.select("doc_id", "w.mask", "w.seed", "w.at").join(seeds, ["mask", "seed"]).select("doc_id", "at", "item_id", "item_at")
        hits = texts.join(hits, "doc_id").select("doc_id", "at", "item_id", "item_at", F.slice("words", F.col("at"), SPAN).alias("window"))
    else:
        hits = corpus.join(near, (F.col("w.seed") == F.col("seed")) & (F.col("w.mask") == F.col("mask"))).select("doc_id", F.col("w.at").alias("at"), "item_id", "item_at", F.slice("words", F.col("w.at"), SPAN).alias("window"))
    found = hits.join(broadcast_if_small(asked, broadcast_bytes), "item_id")
    return found.select("doc_id", "item_id", "at", "item_at", F.zip_with("window", F.slice("item_words", F.col("item_at"), SPAN), lambda a, b: a == b).alias("same"))


def leaks(documents: DataFrame, items: DataFrame, tolerated: int = 0, masks: tuple[str, ...] | None = None, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, windows, best, exact): documents that hold passages of items.

    windows counts the places of the document whose 12 words agree with a window of the item in all but
    `tolerated` words at most, best is the largest number of equal words among them and exact tells whether
    12 consecutive words are equal. With up to two tolerated words nothing is lost: some mask ignores both.
    Equal windows agree under every mask, so without tolerated words one mask is enough. One row per pair,
    however often ids repeat.
    """
    masks = masks or (MASKS if tolerated else MASKS[:1])
    agreeing = F.size(F.filter("same", lambda x: x))
    return (
        seed_hits(documents, items, masks, broadcast_bytes)
        .select("doc_id", "item_id", "at", agreeing.alias("equal"))
        .where(F.col("equal") >= SPAN - tolerated)
        .groupBy("doc_id", "item_id", "at")
        .agg(F.max("equal").alias("equal"))
        .groupBy("doc_id", "item_id")
        .agg(F.count("*").alias("windows"), F.max("equal").alias("best"))
        .withColumn("exact", F.col("best") == SPAN)
    )
