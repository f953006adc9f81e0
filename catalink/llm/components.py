"""Consolidating pairwise matches into groups: low-diameter decomposition, contraction, recursion."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalink.runtime import cut, discard

#: Rate of the exponential head starts and their longest; clusters reach less than LONGEST hops.
RATE, LONGEST = 0.5, 5
#: Links between clusters that one task settles by itself once a level has been decomposed; bounds its memory.
LAST = 50_000
#: Links of one vertex from which it is met in salted parts, and the number of parts.
HUB, PARTS = 100_000, 64


def head_start(vertex: Column, level: int, rate: float, longest: int) -> Column:
    """Exponentially distributed head start below `longest`, a function of the vertex and the level."""
    uniform = F.call_function("shiftrightunsigned", F.xxhash64(vertex, F.lit(level)), F.lit(11)).cast("double") / F.lit(float(1 << 53))
    return -F.log(F.lit(1.0) - uniform * F.lit(1.0 - math.exp(-rate * longest))) / F.lit(rate)


def decompose(edges: DataFrame, level: int, rate: float = RATE, longest: int = LONGEST, hub: int = HUB) -> DataFrame:
    """(v, c): each vertex of the edges (a, b) and the centre of the cluster that reached it first.

    A cluster reaches a vertex at its hops from the centre less the centre's head start. A vertex starts its own
    cluster before time 0, so no other comes from `longest` hops or further: after `longest` rounds all labels
    rest. Each round takes the neighbours' labels; a vertex's own start is a function of its name. Links of a
    hub are met in salted parts; the hubs are at most 2 * links / hub vertices.
    """
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")
    own = F.struct((-head_start(F.col("v"), level, rate, longest)).alias("t"), F.col("v").alias("c"))
    # The first hop needs no join: the head start is a function of the neighbour's name.
    first = F.struct((F.lit(1.0) - head_start(F.col("u"), level, rate, longest)).alias("t"), F.col("u").alias("c"))
    label = both.groupBy("v").agg(F.min(first).alias("x"), F.count("*").alias("n"))
    hubs = None
    if edges.count() >= hub:
        found = cut(label.where(F.col("n") >= hub).select(F.col("v").alias("u"), F.lit(PARTS).alias("parts")))
        hubs = None if found.isEmpty() else found
    label = label.select("v", F.least("x", own).alias("x"))
    on = ["u"]
    if hubs is not None:
        both = both.join(F.broadcast(hubs), "u", "left").select("u", "v", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int")).otherwise(0).alias("part"))
        on = ["u", "part"]
    for _ in range(longest - 1):
        sent = label.select(F.col("v").alias("u"), "x")
        if hubs is not None:
            sent = sent.join(F.broadcast(hubs), "u", "left").select("u", "x", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        near = both.join(sent, on).select("v", F.struct((F.col("x.t") + 1.0).alias("t"), F.col("x.c").alias("c")).alias("x"))
        label = near.groupBy("v").agg(F.min("x").alias("x")).select("v", F.least("x", own).alias("x"))
    return label.select("v", F.col("x.c").alias("c"))


def between(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(a, b): the different pairs of clusters that some edge links, the smaller first."""
    ca, cb = (clusters.select(F.col("v").alias(x), F.col("c").alias("c" + x)) for x in "ab")
    met = edges.join(ca, "a").select("b", "ca").join(cb, "b").where("ca <> cb")
    return met.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()


def _rest(edges: DataFrame) -> DataFrame:
    """(v, c): the few links that are left over, settled in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (above := up.setdefault(x, x)) != x:
                up[x] = x = up[above]
            return x

        for one in batches:
            for a, b in zip(one.column(0).to_pylist(), one.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        yield pa.RecordBatch.from_pydict({"v": pa.array(list(up), pa.int64()), "c": pa.array([root(v) for v in list(up)], pa.int64())})

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "v long, c long")


def components(pairs: DataFrame, a: str, b: str, out: str = "group_key", rate: float = RATE, longest: int = LONGEST, last: int = LAST, hub: int = HUB) -> DataFrame:
    """(key, out): every key of either column and the smallest key of its group (binary string order).

    A row with one side null or empty adds the other side as a key without a link; both missing adds nothing.
    Repeated pairs count once (combined before the shuffle), a pair of equal keys is no link. An empty table
    gives an empty result. Only columns a and b are read.

    Keys are numbered once. Each level cuts the graph into clusters of low diameter, contracts each to its
    centre and goes on with the links between clusters: a link is cut with a probability of about 1 -
    exp(-rate) at most, so their number falls by a constant factor a level. Once at most `last` links
    between clusters are left, one task settles them. Levels are checkpointed, so a lost executor costs no
    earlier level. No vertex's links are gathered in one row: a hub is met by partial minima and salted joins.
    """
    x, y = (F.nullif(F.col(c).cast("string"), F.lit("")) for c in (a, b))
    pairs = cut(pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a is not null").distinct())
    keys = cut(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().withColumn("v", F.monotonically_increasing_id()))
    ka, kb = (keys.select(F.col("key").alias(s), F.col("v").alias("n" + s)) for s in "ab")
    edges = cut(pairs.where("a <> b").join(ka, "a").select("b", "na").join(kb, "b").select(F.col("na").alias("a"), F.col("nb").alias("b")))
    discard(pairs)
    levels: list[DataFrame] = []
    left = edges.count()
    while left:
        if levels and left <= last:
            levels.append(cut(_rest(edges)))
            break
        clusters = cut(decompose(edges, len(levels), rate, longest, hub))
        levels.append(clusters)
        below, edges = edges, cut(between(edges, clusters))
        discard(below)
        left = edges.count()
    if not levels:
        return keys.select("key", F.col("key").alias(out))
    top = levels.pop()
    while levels:
        above = top.select(F.col("v").alias("c"), F.col("c").alias("top"))
        top = levels.pop().join(above, "c", "left").select("v", F.coalesce("top", "c").alias("c"))
    # A centre is a member of its own group, so its name is among the keys.
    named = cut(keys.join(top, "v", "left").select("key", F.coalesce("c", "v").alias("c")))
    least = named.groupBy("c").agg(F.min("key").alias(out))
    return named.join(least, "c").select("key", out)
