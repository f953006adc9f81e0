"""Labelled pairs, vocabularies, tensors, embeddings and metrics for title matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalink.runtime import cut

# Signs that the tokeniser leaves out.
FILTERED = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'


def numbered(rows: DataFrame, order: list[Column], name: str = "index", first: int = 1) -> DataFrame:
    """Rows with their number in an order that tells all rows apart: sorted by ranges, numbered from the sizes of the ranges before."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = cut(ranged.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    # One row per task.
    sizes = sorted((r["__part"], r["n"]) for r in kept.groupBy("__part").agg(F.count("*").alias("n")).collect())
    starts, done = [], first
    for part, n in sizes:
        starts.append((part, done))
        done += n
    start = rows.sparkSession.createDataFrame(starts or [(0, first)], "__part int, __start long")
    return kept.join(F.broadcast(start), "__part").withColumn(name, F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")


def order_key(*columns: str, seed: int = 7) -> Column:
    """A reproducible random order: a hash of the row's own values and a seed."""
    return F.xxhash64(*columns, F.lit(seed))


def sample_split(rows: DataFrame, n: int, keys: list[str], seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Exactly n rows (or all, if fewer) in random order, and the rest. Keys must tell rows apart."""
    chosen = rows.orderBy(order_key(*keys, seed=seed), *keys).limit(n)
    return chosen, rows.join(chosen.select(*keys), keys, "left_anti")


def balanced(positives: DataFrame, negatives: DataFrame, n: int, keys: list[str], seed: int = 7) -> DataFrame:
    """n rows of each kind with label 1 and 0."""
    a, b = sample_split(positives, n, keys, seed)[0], sample_split(negatives, n, keys, seed)[0]
    return a.withColumn("label", F.lit(1)).unionByName(b.withColumn("label", F.lit(0)))


def train_and_rest(pairs: DataFrame, n: int, keys: list[str], seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Four fifths of n pairs of each label to fit on, and all pairs that are not among them to test on."""
    sample = balanced(pairs.where("label = 1").drop("label"), pairs.where("label = 0").drop("label"), n, keys, seed)
    train = sample.where(order_key(*keys, seed=11) % 5 != 0)
    return train, pairs.join(train.select(*keys), keys, "left_anti")


def characters(c: Column) -> Column:
    """Lower-case characters of a text without filtered signs."""
    return F.filter(F.split(F.lower(F.translate(c, FILTERED, "")), ""), lambda x: x != "")


def vocabulary(rows: DataFrame, tokens: Column) -> DataFrame:
    """(token, n, index): tokens by falling frequency, index from 1; equal frequencies stand in order of the token."""
    counted = rows.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return numbered(counted, [F.desc("n"), F.col("token")]).withColumn("index", F.col("index").cast("int"))


def distinct_characters(rows: DataFrame, column: str) -> DataFrame:
    """(token, index): the distinct characters in order, index from 0."""
    each = rows.select(F.explode(F.filter(F.split(column, ""), lambda x: x != "")).alias("token")).distinct()
    return numbered(each, [F.col("token")], first=0)


def sequences(rows: DataFrame, key: str, tokens: Column, vocab: DataFrame, length: int = 150) -> DataFrame:
    """(key, features): indexes of the tokens, the last `length` of them, padded with 0 on the left; unknown tokens are left out."""
    each = rows.select(key, F.posexplode_outer(tokens).alias("pos", "token"))
    known = each.join(vocab.select("token", "index"), "token", "left")
    listed = known.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("index").isNotNull(), F.struct("pos", "index")))), lambda x: x["index"]).alias("x"))
    tail = F.slice("x", F.greatest(F.size("x") - length + 1, F.lit(1)), length)
    return listed.select(key, F.concat(F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size("x"), F.lit(0))), tail).alias("features"))


def pair_sequences(pairs: DataFrame, a: str, b: str, vocab: DataFrame, length: int = 150) -> DataFrame:
    """(a, b, features): the sequences of two texts one behind the other; each distinct text is coded once."""
    texts = pairs.select(F.col(a).alias("t")).union(pairs.select(b)).distinct()
    coded = sequences(texts, "t", characters(F.col("t")), vocab, length)
    one, two = (coded.select(F.col("t").alias(c), F.col("features").alias("f" + s)) for c, s in ((a, "1"), (b, "2")))
    return pairs.select(a, b).join(one.hint("merge"), a).join(two.hint("merge"), b).select(a, b, F.concat("f1", "f2").alias("features"))


def ngram_windows(c: Column, length: int = 40, step: int = 3) -> Column:
    """(window, next): all windows of some length every `step` characters, with the character after each."""
    last = F.length(c) - length - 1
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct((i + 1).alias("at"), F.substring(c, i + 1, F.lit(length)).alias("window"), F.substring(c, i + 1 + length, F.lit(1)).alias("next")))


def character_means(vectors: DataFrame, token: str, vector: str, places: int = 6) -> DataFrame:
    """(ch, i, mean): for each ASCII character the mean vector of the tokens in which it occurs, once per occurrence."""
    each = vectors.select(F.explode(F.filter(F.split(token, ""), lambda x: (x != "") & (F.ascii(x) < 128))).alias("ch"), F.col(vector).alias("v"))
    return each.select("ch", F.posexplode("v").alias("i", "x")).groupBy("ch", "i").agg(F.round(F.avg("x"), places).alias("mean"))


def group_means(vectors: DataFrame, group: str, vector: str, places: int = 6) -> DataFrame:
    """(group, i, mean): mean of each dimension within groups."""
    return vectors.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.round(F.avg("x"), places).alias("mean"))


def embedding_matrix(vocab: DataFrame, vectors: DataFrame, token: str = "token") -> DataFrame:
    """The vocabulary with its vectors, null where there is none."""
    return vocab.join(vectors, token, "left")


def metrics(rows: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """tp, fp, tn, fn, accuracy, precision, recall and f1 of both classes; null where nothing is to be divided."""
    y, p = truth.cast("boolean"), predicted.cast("boolean")
    c = rows.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select(
        "tp", "fp", "tn", "fn",
        ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(2 * tn, 2 * tn + fp + fn).alias("f1_negative"),
    )


def pair_features(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Similarity features of two texts, as columns beside the row."""
    ta, tb = F.col(a), F.col(b)
    wa, wb = F.split(ta, " "), F.split(tb, " ")
    return rows.withColumns(
        {
            "f_distance": F.coalesce(F.try_divide(F.levenshtein(ta, tb), F.greatest(F.length(ta), F.length(tb))), F.lit(0.0)),
            "f_words": F.coalesce(F.try_divide(F.size(F.array_intersect(wa, wb)), F.size(F.array_union(wa, wb))), F.lit(0.0)),
            "f_length": F.coalesce(F.try_divide(F.least(F.length(ta), F.length(tb)), F.greatest(F.length(ta), F.length(tb))), F.lit(0.0)),
            "f_prefix": (ta.startswith(tb) | tb.startswith(ta)).cast("double"),
        }
    )


def title_classifier(train: DataFrame, features: tuple[str, ...] = ("f_distance", "f_words", "f_length", "f_prefix")):  # noqa: ANN201
    """A logistic model over pair features (column label is 0 or 1)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), LogisticRegression(maxIter=50, regParam=1e-3)]).fit(train)


def words(c: Column) -> Column:
    """Lower-case words of a text without filtered signs."""
    return F.filter(F.split(F.lower(F.translate(c, FILTERED, " " * len(FILTERED))), " "), lambda x: x != "")


def predicted(p: Column, threshold: float, distance: Column | None = None) -> Column:
    """Whether a probability is over a threshold; with a distance, only where the texts are equal."""
    return (p > threshold) & (distance < 1) if distance is not None else p > threshold


def exact_split(pairs: DataFrame, train: int, test: int, keys: list[str], seed: int = 7) -> DataFrame:
    """Pairs with split: of each label exactly `train` to fit on, then `test` others, the rest unused; fewer if there are fewer.

    The places are those of a hash-random order within each label.
    """
    parts = []
    for label in (1, 0):
        placed = numbered(pairs.where(F.col("label") == label).withColumn("__h", order_key(*keys, seed=seed)), [F.col("__h"), *map(F.col, keys)], "__n").drop("__h")
        parts.append(placed.withColumn("split", F.when(F.col("__n") <= train, "train").when(F.col("__n") <= train + test, "test").otherwise("rest")).drop("__n"))
    return parts[0].union(parts[1])


def with_replacement(rows: DataFrame, share: float, keys: list[str], seed: int = 7) -> DataFrame:
    """A sample with replacement: each row Poisson(share) times, drawn from a hash of its keys, so it can be drawn again."""
    import math

    u = F.call_function("shiftrightunsigned", order_key(*keys, seed=seed), F.lit(11)).cast("double") / float(1 << 53)
    times, total, k = F.lit(0), 0.0, 0
    while total < 1 - 1e-12 and k < 200:
        total += math.exp(-share) * share**k / math.factorial(k)
        times = times + (u >= total).cast("int")
        k += 1
    return rows.withColumn("__k", F.explode(F.array_repeat(F.lit(0), times))).drop("__k")


def principal(vectors: DataFrame, vector: str, k: int):  # noqa: ANN201
    """A fitted projection of vectors on their k principal components (columns features and pca)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    ready = vectors.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    return PCA(k=k, inputCol="features", outputCol="pca").fit(ready).transform(ready)


def one_hot(windows: DataFrame, key: list[str], window: str, vocab: DataFrame) -> DataFrame:
    """(key, i, index): the place of the one in each row of a window's tensor; characters outside the vocabulary have none."""
    each = windows.select(*key, F.posexplode(F.split(window, "")).alias("i", "token")).where("token <> ''")
    return each.join(vocab.select("token", "index"), "token").select(*key, "i", "index")


def drawn(probabilities: Column, u: Column) -> Column:
    """The place (from 0) that a uniform number u in [0, 1) falls on in a distribution."""
    upto = F.transform(probabilities, lambda _, i: F.aggregate(F.slice(probabilities, 1, i + 1), F.lit(0.0), lambda a, x: a + x))
    return F.least(F.size(F.filter(upto, lambda x: x <= u)), F.size(probabilities) - 1)


def tempered(probabilities: Column, temperature: float) -> Column:
    """A distribution sharpened or flattened by a temperature."""
    powered = F.transform(probabilities, lambda p: F.exp(F.log(p) / F.lit(temperature)))
    return F.transform(powered, lambda x: x / F.aggregate(powered, F.lit(0.0), lambda a, y: a + y))


def coded_fields(c: dict[str, Column], separator: str = "|") -> Column:
    """Fields of an item as one text with separators; missing ones are empty."""
    return F.concat_ws(separator, *[F.coalesce(v, F.lit("")) for v in c.values()])
