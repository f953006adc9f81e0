"""Triples and trees: emission, star and optional joins, closure, taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalink.runtime import cut

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"

#: (property, value, kind of object, datatype, language)
Property = tuple[str, Column, str, str | None, str | None]


def emit(rows: DataFrame, subject: Column, properties: list[Property]) -> DataFrame:
    """(s, p, o, o_kind, o_datatype, o_lang): one row gives a triple per property whose value is neither null nor empty.

    An array value gives a triple per element. Equal triples fall together, as in a set.
    """

    def as_list(value: Column, p: str, kind: str, datatype: str | None, lang: str | None) -> Column:
        return F.transform(value, lambda x: F.struct(F.lit(p).alias("p"), x.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(datatype).cast("string").alias("o_datatype"), F.lit(lang).cast("string").alias("o_lang")))

    parts = []
    for p, value, kind, datatype, lang in properties:
        is_array = rows.select(value.alias("v")).schema["v"].dataType.typeName() == "array"
        parts.append(as_list(F.coalesce(value, F.array().cast("array<string>")) if is_array else F.array(value), p, kind, datatype, lang))
    every = rows.select(subject.alias("s"), F.explode(F.flatten(F.array(*parts))).alias("t")).select("s", "t.*")
    return every.where("o <> ''").dropDuplicates()


def uri(base: str, *parts: Column) -> Column:
    return F.concat(F.lit(base), *parts)


def star(triples: DataFrame, required: dict[str, str], optional: dict[str, str] | None = None, cls: str | None = None) -> DataFrame:
    """One row per subject and combination of values: required properties by inner, optional ones by left join."""
    out = (triples.where((F.col("p") == RDF_TYPE) & (F.col("o") == cls)) if cls else triples).select("s").distinct()
    for name, p in required.items():
        out = out.join(triples.where(F.col("p") == p).select("s", F.col("o").alias(name)), "s")
    for name, p in (optional or {}).items():
        out = out.join(triples.where(F.col("p") == p).select("s", F.col("o").alias(name)), "s", "left")
    return out.distinct()


def wide(triples: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row per subject with the values of each property as a sorted list: one shuffle for all properties."""
    return triples.groupBy("s").agg(*[F.array_sort(F.collect_list(F.when(F.col("p") == p, F.col("o")))).alias(n) for n, p in columns.items()])


def hop(triples: DataFrame, through: str, label: str) -> DataFrame:
    """(s, target, label): subjects, what a property of theirs leads to, and the label found there."""
    a = triples.where(F.col("p") == through).select("s", F.col("o").alias("target"))
    b = triples.where(F.col("p") == label).select(F.col("s").alias("target"), F.col("o").alias("label"))
    return a.join(b, "target").select("s", "target", "label")


def full_name(given: Column, family: Column) -> Column:
    """Given and family name with a blank, or the one there is, or null."""
    return F.nullif(F.trim(F.concat_ws(" ", given, family)), F.lit(""))


def n_triples(triples: DataFrame) -> DataFrame:
    """Lines of an N-Triples file."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), F.lit('"'))
    literal = F.concat(quoted, F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), "o_datatype", F.lit(">"))).otherwise(F.lit("")))
    obj = F.when(F.col("o_kind") == "uri", F.concat(F.lit("<"), "o", F.lit(">"))).when(F.col("o_kind") == "blank", F.col("o")).otherwise(literal)
    return triples.select(F.concat_ws(" ", F.when(F.col("s").startswith("_:"), F.col("s")).otherwise(F.concat(F.lit("<"), "s", F.lit(">"))), F.concat(F.lit("<"), "p", F.lit(">")), obj, F.lit(".")).alias("value"))


def contributor_edges(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, pos, name, role, property, node): one edge per contributor; a collective author is a node of its own per record."""
    from catalink.functions import text

    each = rows.select(key, F.posexplode(text.split_list(F.col(column), ",")).alias("pos", "part"))
    named = each.select(key, "pos", text.contributor_name(F.col("part")).alias("name"), text.contributor_role(F.col("part")).alias("role"))
    node = F.when(F.col("name") == "Collectif", F.concat(F.lit("_:"), F.col(key).cast("string"), F.lit("-"), F.col("pos").cast("string")))
    return named.select(key, "pos", "name", "role", text.role_property(F.col("role")).alias("property"), node.alias("node")).where("name <> ''")


def closure(edges: DataFrame, parent: str, child: str, depth: int = 32) -> DataFrame:
    """(ancestor, descendant, steps): all paths of one step or more, the shortest for each pair; cycles end by themselves.

    The frontier of each round is joined with the edges and known pairs are dropped, so a round handles only
    what is new. Rounds end when nothing is new; going beyond depth is an error, never a silent cut.
    """
    step = cut(edges.select(F.col(parent).alias("ancestor"), F.col(child).alias("descendant")).where("ancestor is not null and descendant is not null").distinct())
    known = frontier = step.withColumn("steps", F.lit(1))
    for n in range(2, depth + 2):
        hop_ = step.select(F.col("ancestor").alias("descendant"), F.col("descendant").alias("next"))
        new = frontier.join(hop_, "descendant").select("ancestor", F.col("next").alias("descendant")).distinct()
        frontier = cut(new.join(known, ["ancestor", "descendant"], "left_anti").withColumn("steps", F.lit(n)))
        if frontier.isEmpty():
            return known
        known = cut(known.union(frontier))
    raise ValueError(f"paths of more than {depth} steps")


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(key, group): every key of either column and the smallest key linked to it, directly or through others.

    Each round takes the least label of the neighbours and then that label's own label, so paths are halved.
    Rounds are checkpointed and end when no label falls.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = cut(both.union(both.select("v", "u")).distinct())
    label = cut(both.groupBy(F.col("u").alias("v")).agg(F.least(F.first("u"), F.min("v")).alias("g")))
    while True:
        near = both.join(label.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("g").alias("h"))
        lower = cut(label.join(near, "v").select("v", "g", F.least("g", "h").alias("h")))
        jump = lower.join(lower.select(F.col("v").alias("h"), F.col("h").alias("j")), "h", "left").select("v", F.least("h", F.coalesce("j", "h")).alias("g"), F.col("g").alias("old"))
        done = cut(jump)
        label = done.select("v", "g")
        if done.where("g <> old").isEmpty():
            return label.select(F.col("v").alias("key"), F.col("g").alias("group"))


def labelled(names: DataFrame, labels: DataFrame, members: DataFrame) -> DataFrame:
    """(name, hits, s): subjects found under a name by any of their labels, among members only; s where the hit is the only one.

    names has name, labels has s and label (labels and other labels in one column), members has s.
    """
    found = names.distinct().join(labels.select("s", F.col("label").alias("name")).distinct(), "name", "left").join(members.select("s", F.lit(True).alias("m")).distinct(), "s", "left")
    return found.groupBy("name").agg(F.count_if("m").alias("hits"), F.when(F.count_if("m") == 1, F.max(F.when(F.col("m"), F.col("s")))).alias("s"))


def taxonomy_paths(nodes: DataFrame, code: str, parent: str, depth: int = 32) -> DataFrame:
    """(code, path, level): each code under its top-level ancestors, whatever the order of rows; the root is ROOT."""
    n = cut(nodes.select(F.col(code).alias("code"), F.col(parent).alias("parent")).distinct())
    level = n.where("parent is null").select("code", F.concat(F.lit("ROOT/"), "code").alias("path"), F.lit(1).alias("level"))
    found = level
    for k in range(2, depth + 2):
        level = cut(n.join(level.select(F.col("code").alias("parent"), F.col("path").alias("above")), "parent").select("code", F.concat_ws("/", "above", "code").alias("path"), F.lit(k).alias("level")))
        if level.isEmpty():
            return found
        found = found.union(level)
    raise ValueError(f"more than {depth} levels, or a cycle")


def skos(nodes: DataFrame, code: str, label: str, parent: str, base: str) -> DataFrame:
    """Triples of a taxonomy: label, preferred label 'code - label' in French, narrower edges, also from the root."""
    ns = "http://www.w3.org/2004/02/skos/core#"
    top = F.concat(F.lit(base), F.coalesce(F.col(parent), F.lit("ROOT")))
    own = F.concat(F.lit(base), F.col(code))
    t = lambda s, p, o, kind, lang: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(lang).cast("string").alias("o_lang"))
    made = nodes.where(F.col(code).isNotNull()).select(F.explode(F.array(t(own, "http://www.w3.org/2000/01/rdf-schema#label", F.col(code), "literal", None), t(own, ns + "prefLabel", F.concat_ws(" - ", code, label), "literal", "fr"), t(top, ns + "narrower", own, "uri", None))).alias("t"))
    return made.select("t.*").distinct()
