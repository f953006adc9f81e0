"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalink.runtime import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: how the byte-level vocabularies part a text before they join bytes.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def counter(tokenizer: str):  # noqa: ANN201
    """A function from texts to their numbers of tokens; a .tiktoken file holds ranks of bytes, any other a whole tokenizer."""
    if tokenizer.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(coder.encode_ordinary(t)) if t else 0 for t in texts]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer)
    whole.encode_special_tokens = True
    return lambda texts: [len(x.ids) for x in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns in keep and n_tokens of a text under a public tokenizer; null and empty texts have 0.

    Whole texts are encoded, strings of special tokens as ordinary text. The file is read once by each task.
    """
    wanted = df.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = df.select(*keep).schema.add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for one in batches:
            texts = one.column(one.num_columns - 1)
            sizes: list[int] = []
            for at in range(0, len(texts), 256):
                sizes += count(texts.slice(at, 256).to_pylist())
            yield pa.RecordBatch.from_arrays([*[one.column(i) for i in range(one.num_columns - 1)], pa.array(sizes, pa.int64())], names=[*keep, "n_tokens"])

    return wanted.mapInArrow(run, schema)


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7, bucket_rows: int = 100_000, total_tokens: int | None = None, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """Two tables: the chosen texts with their repeats, and the shares really reached.

    Each source of targets gets target_weight / sum(target_weight) of the total tokens of all documents
    (or of total_tokens). Equal texts are one text, that of the smallest doc_id, so no text is used more than
    max_repeats times under whatever ids. A source's texts stand in a hash-random order; as many whole
    epochs as fit are taken, then a prefix of the order: a text belongs to it if at least half of its tokens
    lie within the budget, so a source misses its budget by half a text at most unless max_repeats stops it.

    Defined cases: texts of no tokens are never chosen; sources without target are counted in the total
    only; targets without texts reach 0; null or non-positive weights count as 0, a null max_repeats as 1, a
    repeated target source counts once (largest weight); a null source matches no target.

    The order is cut into ranges of the uniform hash, bucket_rows texts in each on average, so that a source
    with most of the texts is spread over many tasks; only sums of buckets meet in one place.
    """
    aims = (
        targets.where("source is not null")
        .groupBy("source")
        .agg(F.max(F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0))).alias("weight"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).cast("bigint").alias("cap"))
    )
    sized = cut(count_tokens(documents.withColumn("__hash", F.sha2(F.col("text"), 256)), ["doc_id", "source", "__hash"], "text", tokenizer))
    total = float(sized.agg(F.sum("n_tokens")).first()[0] or 0) if total_tokens is None else float(total_tokens)
    weights = aims.agg(F.sum("weight")).first()[0] or 0.0
    share = F.coalesce(F.try_divide(F.col("weight"), F.lit(weights)), F.lit(0.0))
    budget = aims.select("source", "cap", share.alias("target_share"), F.floor(share * F.lit(total)).cast("bigint").alias("budget"))
    # One row per distinct text; its copies are combined on the map side.
    texts = (
        sized.where("n_tokens > 0")
        .join(aims.select("source"), "source", "left_semi")
        .groupBy("__hash")
        .agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("x"))
        .select("x.*", F.xxhash64("__hash", F.lit(seed)).alias("__at"))
    )
    texts = cut(texts)
    buckets = max(1, min(1 << 24, -(-texts.count() // bucket_rows)))
    bucket = F.floor((F.col("__at").cast("double") / float(1 << 64) + 0.5) * buckets).cast("int")
    texts = texts.withColumn("__bucket", bucket)
    sums = texts.groupBy("source", "__bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    before = Window.partitionBy("source").orderBy("__bucket")
    sums = sums.select("source", "__bucket", (F.sum("in_bucket").over(before) - F.col("in_bucket")).alias("start"), F.sum("in_bucket").over(Window.partitionBy("source")).alias("available"))
    order = Window.partitionBy("source", "__bucket").orderBy("__at", "doc_id")
    chosen = (
        texts.withColumn("upto", F.sum("n_tokens").over(order))
        .join(sums, ["source", "__bucket"])
        .join(budget, "source")
        .withColumn("epochs", F.least(F.floor(F.col("budget") / F.col("available")), F.col("cap")))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available"))
        .withColumn("more", (F.col("epochs") < F.col("cap")) & ((F.col("start") + F.col("upto")) * 2 - F.col("n_tokens") <= F.col("rest") * 2))
        .select("doc_id", "source", "n_tokens", (F.col("epochs") + F.col("more").cast("int")).cast("int").alias("repeats"))
        .where("repeats > 0")
    )
    chosen = cut(chosen)
    reached = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("reached"), F.count("*").alias("texts"), F.max("repeats").alias("most_repeats"))
    have = texts.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    everything = F.lit(reached.agg(F.sum("reached")).first()[0] or 0)
    shares = (
        budget.join(have, "source", "left")
        .join(reached, "source", "left")
        .select(
            "source",
            "target_share",
            "budget",
            F.coalesce("available", F.lit(0)).alias("available"),
            F.coalesce("texts", F.lit(0)).alias("texts"),
            F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
            F.coalesce("reached", F.lit(0)).alias("reached"),
            F.coalesce(F.try_divide(F.col("reached"), everything), F.lit(0.0)).alias("reached_share"),
        )
    )
    return chosen, shares
