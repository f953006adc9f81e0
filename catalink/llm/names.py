"""Variant spellings of names: symmetric-delete index on tokens, optimal assignment of tokens, grouping."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalink.functions.fold import fold
from catalink.llm.components import components
from catalink.operators.mlprep import numbered
from catalink.runtime import cut, discard

# Tokens that say nothing about who it is (articles, titles, legal forms, folded).
EMPTY_TOKENS = ("de", "du", "des", "la", "le", "les", "et", "inc", "enr", "ltee", "dr", "mme", "mlle", "prof", "pr", "me", "mgr", "the", "of", "and")

PERSON_YEAR = r"\b(1[4-9]\d\d|20\d\d)\b"


def tokens_of(name: Column) -> Column:
    """Folded letter runs of a name in written order; what stands in brackets and empty tokens are left out."""
    plain = F.regexp_replace(fold(F.coalesce(name, F.lit(""))), r"\([^()]*\)|\b[dl]['’]", " ")
    return F.filter(F.regexp_extract_all(plain, F.lit(r"\p{L}+"), F.lit(0)), lambda t: ~t.isin(*EMPTY_TOKENS))


def deletions(token: Column) -> Column:
    """The token and all it leaves when one letter is taken out: two tokens one edit apart share one."""
    n = F.length(token)
    return F.array_distinct(F.concat(F.array(token), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, n)))))


def sound(token: Column) -> Column:
    """A token by how it sounds: spellings of o, f, k and i are one, doubled letters single."""
    for pattern, to in (("e?au", "o"), ("ph", "f"), ("qu|ck|c|q", "k"), ("y", "i")):
        token = F.regexp_replace(token, pattern, to)
    return F.regexp_replace(token, r"(.)\1", "$1")


def one_edit(a: Column, b: Column) -> Column:
    """Whether one letter is exchanged, added, missing or swapped with its neighbour."""
    swapped = (F.length(a) == F.length(b)) & (F.levenshtein(a, b) == 2) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return (F.levenshtein(a, b, 1) >= 0) | swapped


def _joined(tokens: str) -> Column:
    """Neighbouring tokens written as one."""
    return F.transform(F.slice(tokens, 2, F.size(tokens)), lambda t, i: F.concat(F.get(tokens, i), t))


def _options(mentions: DataFrame) -> DataFrame:
    """(token, n, clean, added, options): for each token what it may stand for unless it is itself a clean one.

    mentions has tokens, slug and perhaps `times`, the number of mentions with these. Clean tokens are those of
    the second spelling (`slug`) that some mentions carry. A token is taken for a slip of a clean or clearly more
    frequent token one edit away (found by equal deletions) or of equal sound, and for an alias of what a mention's
    second spelling has in its place, or of what other mentions of one rarer token and one year have in its place
    (with two such tokens at least, and mostly with this one). All options are kept, the likeliest first, equal ones in falling string order. A
    token that several mentions have beyond their whole second spelling, and that no second spelling has, is
    marked as added (a second family name, a legal form).
    """
    if "times" not in mentions.columns:
        mentions = mentions.withColumn("times", F.lit(1).cast("bigint"))
    no = F.lit(0).cast("bigint")
    said = lambda c, n, clean: F.transform(c, lambda t: F.struct(t.alias("token"), n.alias("n"), clean.alias("clean")))
    each = F.concat(said(F.col("tokens"), F.col("times"), no), said(_joined("tokens"), no, no), said(F.col("slug"), no, F.col("times")))
    vocabulary = cut(mentions.select(F.explode(each).alias("x")).groupBy("x.token").agg(F.sum("x.n").alias("n"), F.sum("x.clean").alias("clean")))
    # Keys are shuffled as numbers, and only tokens that are clean or said twice answer: no other is likelier than a slip.
    ways = F.concat(F.transform(deletions(F.col("token")), lambda c: F.struct(F.xxhash64(c).alias("cut"), F.lit(False).alias("heard"))), F.array(F.struct(F.xxhash64(sound(F.col("token")), F.lit("~")).alias("cut"), F.lit(True).alias("heard"))))
    keyed = lambda rows: rows.select("token", "n", "clean", F.explode(ways).alias("x")).select("x.cut", "x.heard", "token", "n", "clean")
    wrong = keyed(vocabulary.where((F.col("clean") == 0) & (F.length("token") >= 4))).select("cut", "heard", F.col("token").alias("slip"), F.col("n").alias("slip_n"))
    right = keyed(vocabulary.where((F.length("token") >= 3) & ((F.col("clean") > 0) | (F.col("n") >= 2))))
    slips = (
        wrong.join(right, ["cut", "heard"])
        .where((F.col("slip") != F.col("token")) & ((F.col("clean") > 0) | (F.col("n") >= 2 * F.greatest("slip_n", F.lit(1)))))
        .where(one_edit(F.col("slip"), F.col("token")) | (F.col("heard") & (sound(F.col("slip")) == sound(F.col("token")))))
        .select("slip", "token", (F.col("n") + F.col("clean")).cast("double").alias("weight"))
    )
    # Aliases: tokens of a name and of its second spelling that have no equal and no near one on the other side.
    rest = mentions.where(F.size("slug") > 0).select("times", F.array_except("tokens", "slug").alias("a"), F.array_except("slug", "tokens").alias("b"))
    rest = rest.where((F.size("a") > 0) & (F.size("b") > 0)).select("times", (F.size("a") == 1).alias("one_a"), (F.size("b") == 1).alias("one_b"), F.explode("a").alias("slip"), "b").select("times", "one_a", "one_b", "slip", F.explode("b").alias("token"))
    alias = (
        rest.where((F.length("slip") >= 2) & (F.col("one_a") & F.col("one_b") | F.col("token").startswith(F.col("slip"))))
        .groupBy("slip", "token")
        .agg(F.sum("times").alias("times"))
        .where((F.col("times") >= 2) | F.col("token").startswith(F.col("slip")))
        .select("slip", "token", (F.col("times") * 1e6).alias("weight"))
    )
    # Each is made by itself, so that not all their shuffle files lie there at once.
    slips, told = cut(slips.distinct()), cut(_told_by_years(mentions, vocabulary))
    # The options of one token are bounded by its edits and aliases, not by the number of rows.
    many = slips.union(alias).union(told).groupBy("slip").agg(F.array_distinct(F.transform(F.sort_array(F.collect_set(F.struct("weight", "token")), False), lambda x: x.token)).alias("options"))
    beyond = mentions.where((F.size("slug") > 0) & (F.size(F.array_except("slug", "tokens")) == 0)).select("slug", F.explode(F.array_except("tokens", "slug")).alias("token")).where(F.length("token") > 1)
    beyond = beyond.distinct().groupBy("token").agg(F.count("*").alias("times")).where("times >= 3")
    none, nothing = F.array().cast("array<string>"), F.lit(False)
    every = vocabulary.select("token", "n", "clean", nothing.alias("added"), none.alias("options")).union(many.select("slip", no, no, nothing, "options")).union(beyond.select("token", no, no, F.lit(True), none))
    every = every.groupBy("token").agg(F.max("n").alias("n"), F.max("clean").alias("clean"), F.max("added").alias("added"), F.max("options").alias("options"))
    dirty = F.col("clean") == 0
    return every.select("token", "n", "clean", (F.col("added") & dirty).alias("added"), F.when(dirty, F.col("options")).otherwise(none).alias("options"))


def _told_by_years(mentions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(slip, token, weight): what stands in a token's place in other mentions with the same rarer token and the same year.

    Only mentions of two full tokens and a year speak. A token that is no clean one stands for a clean one if at
    least two rarer tokens say so and no more say otherwise.
    """
    if "year" not in mentions.columns:
        return mentions.sparkSession.createDataFrame([], "slip string, token string, weight double")
    full = F.filter("tokens", lambda t: F.length(t) > 1)
    two = mentions.where("year is not null").select("year", "place", full.alias("t")).where("size(t) = 2")
    each = two.select("year", "place", F.explode(F.array(F.struct(F.get("t", 0).alias("family"), F.get("t", 1).alias("given")), F.struct(F.get("t", 1).alias("family"), F.get("t", 0).alias("given")))).alias("x")).select("year", "place", "x.*").distinct()
    known = vocabulary.select("token", (F.col("n") + F.col("clean")).alias("df"), (F.col("clean") > 0).alias("sure"))
    each = each.join(known.select(F.col("token").alias("family"), F.col("df").alias("df_f")), "family").join(known.select(F.col("token").alias("given"), F.col("df").alias("df_g"), "sure"), "given").where("df_f < df_g")
    a, b = each.where("not sure").select("family", "year", F.col("place").alias("pa"), F.col("given").alias("slip")), each.where("sure").select("family", "year", F.col("place").alias("pb"), F.col("given").alias("token"))
    met = a.join(b, ["family", "year"]).where(F.coalesce(F.col("pa") == F.col("pb"), F.lit(True))).groupBy("slip", "token").agg(F.count_distinct("family").alias("times"))
    whole = met.groupBy("slip").agg(F.sum("times").alias("all"))
    return met.join(whole, "slip").where("times >= 2 and times * 2 >= all").select("slip", "token", (F.col("times") * 1e6).alias("weight"))


NOTHING = (0, 0, False, [])


def _written(name: list[list[str]]) -> str:
    """A settled name as one text, which takes a part of its arrays' room wherever it is shuffled."""
    return json.dumps(name, ensure_ascii=False, separators=(",", ":"))


def _read(name: str) -> list[list[str]]:
    return json.loads(name)


def _settle(tokens: list[str], known: dict[str, tuple[int, int, bool, list[str]]]) -> list[list[str]]:
    """For each token of a name what it may stand for.

    Two halves of a known token become one, two consonants are two initials, added tokens are left out
    where two others remain.
    """
    out, added, i = [], [], 0
    while i < len(tokens):
        t = tokens[i]
        n, clean, more, options = known.get(t, NOTHING)
        if i + 1 < len(tokens) and len(t) > 1 and len(tokens[i + 1]) > 1 and len(t) + len(tokens[i + 1]) >= 5:
            other = known.get(tokens[i + 1], NOTHING)
            both = known.get(t + tokens[i + 1], NOTHING)
            whole = both[1] or both[0] or any(known.get(o, NOTHING)[1] for o in both[3])
            # Not where one half is clean and the other is clean or a slip or alias of a clean token.
            fine = clean and (other[1] or other[3]) or options and other[1]
            if whole and not more and not other[2] and not fine:
                out.append([t + tokens[i + 1], *([] if both[1] else both[3])])
                i += 2
                continue
        if more:
            added.append([t])
        elif len(t) == 2 and not clean and not options and not set(t) & set("aeiouy"):
            out += [[t[0]], [t[1]]]
        else:
            out.append([t] if clean else [t, *options])
        i += 1
    return out if len(out) >= 2 else out + added


def _prefer(name: list[list[str]], slug: list[str]) -> list[list[str]]:
    """The second spelling in place of a name that shares a token with it, and the full tokens it has beyond it."""
    _, full, _, _ = compare_names(name, [[x] for x in slug])
    if not full:
        return name
    spare = sum(len(x[0]) > 1 for x in name) - len(slug)
    rest = [x for x in name if len(x[0]) > 1 and not any(_alike(x, [s]) for s in slug)]
    return [[s] for s in slug] + (rest[-spare:] if spare > 0 else [])


def _alike(a: list[str], b: list[str]) -> float:
    """How well two tokens fit: equal 3, through a slip or alias 2, initial 1, else 0."""
    if a[0] == b[0] and len(a[0]) > 1:
        return 3.0
    if len(a[0]) > 1 and len(b[0]) > 1:
        return 2.0 if set(a) & set(b) or (min(len(a[0]), len(b[0])) >= 2 and any(x.startswith(b[0]) for x in a if len(b[0]) >= 3) or any(y.startswith(a[0]) for y in b if len(a[0]) >= 3)) else 0.0
    firsts = {x[0] for x in a} & {y[0] for y in b}
    return 1.0 if firsts else 0.0


def assignment(fit: list[list[float]]) -> list[int]:
    """The column of each row so that the sum of fits is largest; rows are not more than columns.

    Rows enter one by one along shortest augmenting paths over row and column prices, so names of any length
    are assigned optimally in cubic time.
    """
    n, m = len(fit), len(fit[0]) if fit else 0
    high = [0.0] * (n + 1)
    low = [0.0] * (m + 1)
    row_of, came = [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, done = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            done[j] = True
            here, step, to = row_of[j], float("inf"), 0
            for k in range(1, m + 1):
                if not done[k]:
                    cost = -fit[here - 1][k - 1] - high[here] - low[k]
                    if cost < least[k]:
                        least[k], came[k] = cost, j
                    if least[k] < step:
                        step, to = least[k], k
            for k in range(m + 1):
                if done[k]:
                    high[row_of[k]] += step
                    low[k] -= step
                else:
                    least[k] -= step
            j = to
            if not row_of[j]:
                break
        while j:
            row_of[j] = row_of[came[j]]
            j = came[j]
    out = [0] * n
    for k in range(1, m + 1):
        if row_of[k]:
            out[row_of[k] - 1] = k - 1
    return out


def compare_names(a: list[list[str]], b: list[list[str]]) -> tuple[float, int, int, int]:
    """Optimal assignment of the tokens of two names.

    Returns the total fit, the number of pairs of full tokens, the number of initials that stand for a full
    token or an equal initial, and the number of full tokens left over on the side that has fewer of them.
    """
    if len(a) > len(b):
        a, b = b, a
    fit = [[_alike(x, y) for y in b] for x in a]
    pairs = [(i, j) for i, j in enumerate(assignment(fit)) if fit[i][j]]
    total = sum(fit[i][j] for i, j in pairs)
    full = sum(fit[i][j] >= 2 for i, j in pairs)
    initials = sum(fit[i][j] == 1 for i, j in pairs)
    in_a, in_b = {i for i, _ in pairs}, {j for _, j in pairs}
    left = [sum(len(x[0]) > 1 for i, x in enumerate(side) if i not in met) for side, met in ((a, in_a), (b, in_b))]
    return total, full, initials, min(left) * 100 + max(left)


def name_keys(names: DataFrame) -> DataFrame:
    """(whole, k, kind): blocking keys of settled names; whole tells names apart.

    kind "all" is every pair of full tokens of a name, "two" those of its two rarest places, "head" every full
    token with the first letter of another one, "initial" every full token with every initial, "alone" the same of names with one full token only, "stem" every full token
    with the first three and four letters of a longer one, "short" every full token with another one of so many letters.
    """
    spread = names.select("whole", "name", F.explode(F.array_distinct(F.flatten(F.filter("name", lambda x: F.length(F.get(x, 0)) > 1)))).alias("t"))
    usual = spread.groupBy("t").agg(F.count("*").alias("df"))
    number = names.schema["whole"].dataType
    told = spread.join(usual, "t").groupBy("whole").agg(F.first("name").alias("name"), F.collect_list(F.struct("t", "df")).alias("df"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            wholes, ks, kinds = [], [], []
            for whole, name, df in zip(one.column("whole").to_pylist(), one.column("name").to_pylist(), one.column("df").to_pylist(), strict=True):
                for k, kind in keys_of(name, {x["t"]: x["df"] for x in df}):
                    wholes.append(whole)
                    ks.append(k)
                    kinds.append(kind)
            yield pa.RecordBatch.from_pydict({"whole": pa.array(wholes, one.column("whole").type), "k": pa.array(ks, pa.string()), "kind": pa.array(kinds, pa.string())})

    return told.mapInArrow(run, f"whole {number.simpleString()}, k string, kind string")


def keys_of(name: list[list[str]], df: dict[str, int]) -> set[tuple[str, str]]:
    """(key, kind) of one settled name under the numbers of names in which its tokens occur."""
    places = [(max(df[t] for t in x), i, x) for i, x in enumerate(name) if len(x[0]) > 1]
    initials = {x[0] for x in name if len(x[0]) == 1}
    pair = lambda x, y: {"|".join(sorted((s, t))) for s in x for t in y}
    out = {(f"{t}|{h}", "initial") for _, _, x in places for t in x for h in initials}
    if len(places) == 1:
        out |= {(k, "alone") for k, _ in out}
    for _, i, x in places:
        for _, j, y in places:
            if i < j:
                out |= {(k, "all") for k in pair(x, y)}
            if i != j:
                out |= {(f"{t}|{u[0]}", "head") for t in x for u in y}
                out |= {(f"{t}|{u[:n]}~", "stem") for t in x for u in y for n in (3, 4) if len(u) > n}
                out |= {(f"{t}|{y[0]}~", "short") for t in x if 3 <= len(y[0]) <= 4}
    # A place is as usual as the most usual token that may stand in it.
    rare = sorted(places)[:2]
    if len(rare) == 2:
        out |= {(k, "two") for k in pair(rare[0][2], rare[1][2])}
    return out


def meeting(keys: DataFrame) -> DataFrame:
    """(a, b): the names of name_keys that meet, a not after b; a name meets itself.

    Of two names that fit, one has no full token beyond the other. Either each of its tokens has a full one there,
    then its two rarest are a pair of the other's; or an initial stands for a full token or an equal one, or a short
    form for a longer one, beside a full one that both have. So one side's rarest pair is enough, and pairs of usual tokens ("imprimerie", "fils") never meet
    each other.
    """
    # Keys of pairs and of letters differ in what stands behind the bar.
    side = lambda kinds, name: keys.where(F.col("kind").isin(*kinds)).select(F.xxhash64("k").alias("k"), F.col("whole").alias(name))
    # Dealt out by key before it is made distinct, it is shuffled once.
    found = side(("two", "initial", "short"), "x").join(side(("all", "head", "alone", "stem"), "y").repartition("k").distinct(), "k")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def fit_of(x: list[list[str]], y: list[list[str]]) -> float | None:
    """How well two settled names fit, None if they are not of one author."""
    # Names that both have a full token like none of the other's do not fit, however the rest is assigned.
    lone = lambda a, b: any(len(t[0]) > 1 and not any(_alike(t, u) for u in b) for t in a)
    if lone(x, y) and lone(y, x):
        return None
    total, full, initials, left_over = compare_names(x, y)
    least, most = divmod(left_over, 100)
    ok = full + initials >= 2 and full >= 1 and least == 0 and most <= 1
    if ok and most and max(len(x), len(y)) > 3 and full < 2:
        ok = False
    if ok and most and full < 2 and min(sum(len(t[0]) > 1 for t in n) for n in (x, y)) > 1:
        ok = False  # a second initial ("Roy, Fabienne L.") must not stand for the family name of another ("Lac, Fabienne")
    if ok and any(len(n) >= 3 and any(t[0] in BODIES for t in n) for n in (x, y)):
        ok = most == 0  # of a body every token counts
    return total - 0.5 * most if ok else None


def link_names(mentions: DataFrame) -> DataFrame:
    """(key, author): mentions of persons and bodies, with one author key for all spellings of one.

    mentions has key, tokens, slug (a second, clean spelling's tokens or an empty list), year, place.

    Nodes are distinct (tokens, slug, year, place), so exact copies cost nothing. Two names meet if one's two
    rarest full tokens are among those of the other, or if they share a full token and one has an initial where
    the other has a full one; slips and aliases count as what they stand for. Their tokens are aligned
    by optimal assignment. Names fit if no full token is left over on both sides and two tokens at least
    agree. Years of birth must not differ. Fitting nodes that also agree in year or place are joined first;
    groups without such evidence between them are joined only if they fit one author alone.

    Null keys are left out; a name without two tokens is its own author unless its tokens, year and place
    are those of another mention. Null years and places are unknown. Extra columns are not read.
    """
    node = F.sha2(F.concat_ws("\u0001", F.array_join("tokens", " "), F.array_join("slug", " "), F.coalesce(F.col("year").cast("string"), F.lit("")), F.coalesce("place", F.lit(""))), 256).substr(1, 24)
    mentions = cut(mentions.where("key is not null").select("key", "tokens", "slug", "year", "place").withColumn("node", node))
    names = cut(mentions.groupBy("node").agg(*[F.first(c).alias(c) for c in ("tokens", "slug", "year", "place")], F.count("*").alias("times")).withColumn("i", F.monotonically_increasing_id()))
    known = _options(names)
    # A token of which nothing is known is told to no name; what is known travels as one text.
    known = known.where((F.col("n") > 0) | (F.col("clean") > 0) | F.col("added") | (F.size("options") > 0))
    known = cut(known.select("token", F.concat_ws("\u0001", "token", "n", "clean", F.col("added").cast("int"), "options").alias("known")))
    asked = names.select("i", F.explode(F.array_distinct(F.concat("tokens", _joined("tokens"), "slug"))).alias("token"))
    told = cut(asked.join(known, "token").groupBy("i").agg(F.collect_list("known").alias("known")))
    discard(known)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            columns = {c: one.column(c).to_pylist() for c in ("tokens", "slug", "known")}
            settled = []
            for tokens, slug, known_ in zip(columns["tokens"], columns["slug"], columns["known"], strict=True):
                d = {t: (int(n), int(clean), more == "1", options) for t, n, clean, more, *options in (k.split("\u0001") for k in known_ or [])}
                name = _settle(list(tokens), d)
                if slug:
                    name = _prefer(name, list(slug))
                settled.append(_written(name))
            yield pa.RecordBatch.from_arrays([one.column(c) for c in ("node", "year", "place")] + [pa.array(settled, pa.string())], names=["node", "year", "place", "name"])

    settled = names.join(told, "i", "left").select("node", "year", "place", "tokens", "slug", "known").mapInArrow(settle, "node string, year int, place string, name string")
    # Names are compared once, however many nodes have them.
    settled = settled.withColumn("whole", F.sha2("name", 256).substr(1, 24))
    # Nodes of one settled name with one year and place, of which one at least is known, are of one author; they go on as one.
    said = F.coalesce(F.col("year").cast("string"), F.lit("")), F.coalesce("place", F.lit(""))
    one = F.sha2(F.concat_ws("\u0001", "whole", *said), 256).substr(1, 24)
    spelled = cut(settled.withColumn("class", F.when(F.col("year").isNotNull() | F.col("place").isNotNull(), one).otherwise(F.col("node"))))
    discard(told)
    discard(names)
    # Names go by their numbers from here on.
    wholes = cut(numbered(spelled.select("whole", "name").distinct(), [F.col("whole")], "w"))
    settled = cut(spelled.select(F.col("class").alias("node"), "whole", "year", "place").distinct().join(wholes.select("whole", "w"), "whole").select("node", "w", "year", "place"))
    classes = cut(spelled.select("node", "class"))
    discard(spelled)
    wholes = wholes.select("w", "name")
    keys = cut(name_keys(wholes.select(F.col("w").alias("whole"), F.from_json("name", "array<array<string>>").alias("name"))))
    met = cut(meeting(keys))
    discard(keys)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            fits = [fit_of(_read(x), _read(y)) for x, y in zip(one.column("name_a").to_pylist(), one.column("name_b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([one.column("a"), one.column("b"), pa.array(fits, pa.float64())], names=["whole_a", "whole_b", "fit"])

    both = met.join(wholes.toDF("a", "name_a"), "a").join(wholes.toDF("b", "name_b"), "b")
    fitting = cut(both.select("a", "b", "name_a", "name_b").mapInArrow(judge, "whole_a bigint, whole_b bigint, fit double").where("fit is not null"))
    discard(met)
    left, right = (settled.select(F.col("w").alias("whole_" + x), F.col("node").alias(x), F.col("year").alias("year_" + x), F.col("place").alias("place_" + x)) for x in "ab")
    same = lambda c: F.coalesce(F.col(c + "_a") == F.col(c + "_b"), F.lit(False))
    other = lambda c: F.coalesce(F.col(c + "_a") != F.col(c + "_b"), F.lit(False))
    fitting = fitting.join(left, "whole_a").join(right, "whole_b")
    # Nodes of one name meet once.
    fitting = fitting.where(((F.col("whole_a") != F.col("whole_b")) | (F.col("a") < F.col("b"))) & ~other("year"))
    fitting = cut(fitting.select("a", "b", "fit", (same("year") & ~other("place") | same("place")).alias("sure")))
    groups = components(fitting.where("sure"), "a", "b", "group")
    every = cut(settled.select("node", "year", "place").join(groups.withColumnRenamed("key", "node"), "node", "left").withColumn("group", F.coalesce("group", "node")))
    facts = cut(every.groupBy("group").agg(F.min("year").alias("year"), F.max("year").alias("year2"), F.min("place").alias("place"), F.max("place").alias("place2")))
    member = every.select("node", "group")
    # Between groups only fits without evidence are left; a group that fits several different authors stays alone.
    loose = (
        fitting.where("not sure")
        .join(member.select(F.col("node").alias("a"), F.col("group").alias("ga")), "a")
        .join(member.select(F.col("node").alias("b"), F.col("group").alias("gb")), "b")
        .where("ga <> gb")
        .select(F.least("ga", "gb").alias("ga"), F.greatest("ga", "gb").alias("gb"), "fit")
        .groupBy("ga", "gb")
        .agg(F.max("fit").alias("fit"))
    )
    fa, fb = (facts.select(F.col("group").alias("g" + x), *[F.col(c).alias(c + "_" + x) for c in ("year", "year2", "place", "place2")]) for x in "ab")
    loose = cut(loose.join(fa, "ga").join(fb, "gb").where(~(other("year") | other("year2") | other("place") | other("place2"))))
    sides = lambda x, y: F.struct(F.col("g" + x).alias("g"), F.col("g" + y).alias("h"), "fit", *[F.col(f"{c}_{s}").alias(n) for c, s, n in (("year", x, "own_y"), ("place", x, "own_p"), ("year", y, "y"), ("place", y, "p"))])
    ways = loose.select(F.explode(F.array(sides("a", "b"), sides("b", "a"))).alias("w")).select("w.*")
    best = cut(ways.join(ways.groupBy("g").agg(F.max("fit").alias("top")), "g").where("fit >= top"))
    year, place = F.coalesce("own_y", "y"), F.coalesce("own_p", "p")
    one = lambda c: F.coalesce(F.min(c) == F.max(c), F.lit(True))
    whole = best.groupBy("g").agg((one(year) & one(place)).alias("one")).where("one").select("g")
    chosen = best.join(whole, "g").select(F.least("g", "h").alias("ga"), F.greatest("g", "h").alias("gb"), "g", (F.col("own_y").isNull() & F.col("own_p").isNull()).alias("silent"))
    # Both chose each other, or one that says nothing of itself chose the other.
    agreed = chosen.groupBy("ga", "gb").agg(F.max("silent").alias("silent"), (F.min("g") != F.max("g")).alias("both")).where("silent or both")
    merged = components(agreed, "ga", "gb", "author")
    authors = member.join(merged.withColumnRenamed("key", "group"), "group", "left").select(F.col("node").alias("class"), F.coalesce("author", "group").alias("author"))
    authors = classes.join(authors, "class").select("node", "author")
    # Nodes carry their own rows; equal rows have equal nodes.
    return mentions.select("key", "node").join(authors, "node").select("key", "author")


# Words that open the name of a body, folded, with usual short forms.
BODIES = frozenset("association assoc ass societe soc groupe gr comite com imprimerie impr imp theatre th centre atelier editions institut musee ville universite".split())


def author_mentions(notices: DataFrame, pages: DataFrame) -> DataFrame:
    """(key, tokens, slug, year, place): author notices and author pages as mentions.

    A year is a four-digit year in its field or, failing that, in the name; stand-ins for "unknown" are null.
    """

    def year(field: Column, name: Column) -> Column:
        of = lambda c: F.regexp_extract(c, PERSON_YEAR, 1).try_cast("int")
        return F.coalesce(of(field), of(name))

    place = lambda c: F.when(fold(c).rlike(r"\p{L}{2}") & ~F.trim(fold(c)).rlike("^(x|null|n/?a|inconnue?|n\\.?d\\.?|s\\.?[nld]\\.?|non renseigne)$"), F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", " ")))
    whole = F.concat_ws(" ", "nom", "prenom")
    slug = F.regexp_extract(F.coalesce("url", F.lit("")), r"^/auteur/([^/]+)", 1)
    none = F.array().cast("array<string>")
    return notices.select(F.col("auteur_key").alias("key"), tokens_of(whole).alias("tokens"), none.alias("slug"), year(F.col("annee_naissance"), whole).alias("year"), place(F.col("lieu_naissance")).alias("place")).union(
        pages.select("author_key", tokens_of(F.col("name")), F.when(F.length(slug) > 0, tokens_of(slug)).otherwise(none), year(F.col("date_of_birth"), F.col("name")), place(F.col("place_of_birth")))
    )


def name_pairs(linked: DataFrame) -> DataFrame:
    """(key_a, key_b): every pair of different keys of one author, the smaller first."""
    keys = linked.distinct()
    return keys.select(F.col("key").alias("key_a"), "author").join(keys.select(F.col("key").alias("key_b"), "author"), "author").where("key_a < key_b").select("key_a", "key_b")
