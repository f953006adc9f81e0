"""Record comparison: decision table, lossless blocking, tiers of similarity, confirmation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalink.functions import text
from catalink.operators.mlprep import numbered
from catalink.runtime import cut

#: Shape of a book record, whatever its source.
BOOK = ("id", "data_base", "title", "authors", "isbns", "title_raw", "authors_raw", "isbns_raw")


def book(rows: DataFrame, id_: Column, source: Column, title: Column, authors: Column, isbns: Column, split_multi: bool = False) -> DataFrame:
    """Canonical records: raw values kept, normalised ones beside them, empty normalised values left out.

    With split_multi several ISBNs of one text are parted first. Null lists are empty lists.
    """
    none = F.array().cast("array<string>")
    raw_isbns = F.coalesce(isbns, none)
    if split_multi:
        raw_isbns = F.flatten(F.transform(F.filter(raw_isbns, lambda x: x.isNotNull()), text.split_isbns))
    return rows.select(
        id_.cast("string").alias("id"),
        source.alias("data_base"),
        text.normalize(title).alias("title"),
        F.filter(F.transform(F.coalesce(authors, none), text.normalize_author), lambda x: x != "").alias("authors"),
        F.filter(F.transform(raw_isbns, text.normalize_isbn), lambda x: x != "").alias("isbns"),
        title.alias("title_raw"),
        F.coalesce(authors, none).alias("authors_raw"),
        raw_isbns.alias("isbns_raw"),
    )


def valid(rows: DataFrame) -> DataFrame:
    """Records with a title or an id."""
    return rows.where((F.coalesce("title", F.lit("")) != "") | (F.coalesce("id", F.lit("")) != ""))


def library_books(notices: DataFrame, pages: DataFrame) -> DataFrame:
    """The union of all sources as book records."""
    a = book(notices, F.col("id_livre"), F.col("source"), F.col("titre"), F.col("auteurs"), F.col("isbn"))
    b = book(pages, F.col("rec_id"), F.lit("babelio"), F.col("title"), F.transform("author", lambda x: text.swap_name(x)), F.when(F.col("ean").isNotNull(), F.array("ean")))
    return valid(a).unionByName(valid(b))


# --- criteria -------------------------------------------------------------------------------------------------


def bound(shorter: Column, k: int = 4) -> Column:
    """Largest distance that still counts as equal: d < max(1, m / k) for the length m of the shorter text."""
    return (F.ceil(F.greatest(F.lit(1.0), shorter / F.lit(float(k)))) - 1).cast("int")


def title_equal(a: Column, b: Column, k: int = 4) -> Column:
    """d < max(1, m/k) with an early end of the distance computation."""
    return F.levenshtein(a, b) <= bound(F.least(F.length(a), F.length(b)), k)


def isbn_verdict(a: Column, b: Column) -> Column:
    """EQ if any two ISBNs agree in the first twelve places, NOINFO if either list is empty, else NEQ."""
    first = lambda x: F.transform(x, lambda i: F.substring(i, 1, 12))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), "NOINFO").when(F.arrays_overlap(first(a), first(b)), "EQ").otherwise("NEQ")


def author_verdict(a: Column, b: Column) -> Column:
    """EQ if any two authors share a word, particles included, NOINFO if either list is empty, else NEQ."""
    words = lambda x: F.flatten(F.transform(x, lambda n: F.split(n, " ")))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), "NOINFO").when(F.arrays_overlap(words(a), words(b)), "EQ").otherwise("NEQ")


def title_verdict(a: Column, b: Column, k: int = 4) -> Column:
    return F.when(a.isNull() | b.isNull(), "NOINFO").when(title_equal(a, b, k), "EQ").otherwise("NEQ")


def case_of(t1: Column, t2: Column, i1: Column, i2: Column, a1: Column, a2: Column) -> Column:
    """The decision table over titles, ISBNs and authors; a null title gives PAS_INFO."""
    m = F.least(F.length(t1), F.length(t2))
    d = F.levenshtein(t1, t2)
    eq = d < F.greatest(F.lit(1.0), m / F.lit(4.0))
    far = d >= m / F.lit(2.0)
    isbn, who = isbn_verdict(i1, i2), author_verdict(a1, a2)
    return (
        F.when(t1.isNull() | t2.isNull(), "PAS_INFO")
        .when((isbn == "NEQ") & eq & (who == "NOINFO"), "ISBN_DIFF_TITRE_EQ")
        .when((isbn == "NEQ") & eq & (who == "EQ"), "ISBN_DIFF_TITRE_AUTEUR_EQ")
        .when((isbn == "EQ") & eq, "ISBN_TITRE_EQ")
        .when((isbn == "EQ") & ~far, "ISBN_EQ_TITRE_DIFF")
        .when((isbn == "EQ"), "ISBN_EQ_TITRE_T_DIFF")
        .when((isbn == "NOINFO") & eq & (who == "NEQ"), "TITRE_EQ_AUTEUR_DIFF")
        .when((isbn == "NOINFO") & eq & (who == "NOINFO"), "TITRE_EQ")
        .when((isbn == "NOINFO") & eq & (who == "EQ"), "TITRE_AUTEUR_EQ")
        .otherwise("PAS_INFO")
    )


# --- blocking -------------------------------------------------------------------------------------------------


def _pieces(length: Column, k: int) -> Column:
    """Number of segments of a text of some length: one more than the distance allowed."""
    return bound(length, k) + 1


def _start(i: Column, length: Column, n: Column) -> Column:
    """First place (from 1) of segment i (from 0) of n even segments, the longer ones last."""
    base = F.floor(length / n)
    short = n - length % n
    return (F.when(i <= short, i * base).otherwise(short * base + (i - short) * (base + 1)) + 1).cast("int")


#: Letters of the signature and up to how many of each are told apart; 62 bits in all.
_COUNTED = {**dict.fromkeys("eaisntrlou", 4), **dict.fromkeys("dcmpéèvghbfqjxyzà êwk- ", 1)}
#: Longs that hold the bits of a text's letter pairs, 64 bits each.
_WORDS = 4


def _signature(c: Column) -> Column:
    """62 bits of unary letter counts: an exchange loses one bit and adds one, an insertion adds one, a deletion loses one, at most."""
    total, bit = F.lit(0).cast("bigint"), 0
    for letter, most in _COUNTED.items():
        n = F.least(F.length(c) - F.length(F.translate(c, letter, "")), F.lit(most))
        total = total + F.shiftleft(F.call_function("shiftleft", F.lit(1).cast("bigint"), n) - 1, bit)
        bit += most
    assert bit <= 62
    return total


def _letter_pairs(c: Column) -> list[Column]:
    """Which hashed pairs of neighbouring letters a text has, as bits of _WORDS longs: an exchange or a deletion loses at most two, an insertion one."""
    places = F.when(F.length(c) > 1, F.sequence(F.lit(1), F.length(c) - 1)).otherwise(F.array().cast("array<int>"))
    slots = F.transform(places, lambda p: F.pmod(F.xxhash64(F.substring(c, p, F.lit(2))), F.lit(64 * _WORDS)).cast("int"))
    none = F.lit(0).cast("bigint")

    def word(w: int) -> Column:
        bit = lambda x: F.when(F.shiftright(x, 6) == w, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(x, F.lit(64)))).otherwise(none)
        return F.aggregate(slots, none, lambda bits, x: bits.bitwiseOR(bit(x)))

    return [word(w) for w in range(_WORDS)]


def _signed(texts: DataFrame) -> DataFrame:
    """(x, sig, g0, ...): the texts with their signatures, made once and dealt out evenly."""
    x = texts.toDF("x").where("x is not null")
    many = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(x.repartition(many, "x").select("x", _signature(F.col("x")).alias("sig"), *[g.alias(f"g{i}") for i, g in enumerate(_letter_pairs(F.col("x")))]))


def similar_texts(left: DataFrame, right: DataFrame | None = None, k: int = 4) -> DataFrame:
    """(a, b): all pairs of texts with d < max(1, m/k), by partition into segments.

    left and right have one column of distinct texts; without right, left is compared with itself, each pair coming
    in both orders. The shorter text of a pair is cut into one segment more
    than the distance allowed, so one of them stands unchanged in the longer text, shifted by the distance at
    most; only pairs with such a segment are compared, and their distance only if their letters and letter pairs allow
    it. Two empty texts are equal; nulls match nothing. The segments of a text take many times its size, which no
    estimate knows, so they are merged and never broadcast.
    """
    signs = ["sig", *[f"g{i}" for i in range(_WORDS)]]

    def one_way(short: DataFrame, long: DataFrame, strict: bool) -> DataFrame:
        own, other = [c + "_s" for c in signs], [c + "_l" for c in signs]
        s = short.toDF("s", *own).withColumn("n", F.length("s"))
        index = s.select("s", *own, "n", F.explode(F.sequence(F.lit(0), _pieces(F.col("n"), k) - 1)).alias("i")).withColumn("at", _start(F.col("i"), F.col("n"), _pieces(F.col("n"), k)))
        index = index.withColumn("seg", F.substring(F.col("s"), F.col("at"), _start(F.col("i") + 1, F.col("n"), _pieces(F.col("n"), k)) - F.col("at"))).select("s", *own, "n", "i", "seg")
        l = long.toDF("l", *other).withColumn("len", F.length("l"))  # noqa: E741
        lengths = F.filter(F.sequence(F.greatest(F.lit(0), (F.col("len") * (1 - 1.0 / k)).cast("int") - 1), F.col("len")), lambda n: n + bound(n, k) >= F.col("len"))
        probe = l.select("l", *other, "len", F.explode(lengths).alias("n"))
        if strict:
            probe = probe.where("n < len")
        probe = probe.select("l", *other, "n", (F.col("len") - F.col("n")).alias("gap"), F.explode(F.sequence(F.lit(0), _pieces(F.col("n"), k) - 1)).alias("i"))
        probe = probe.withColumn("at", _start(F.col("i"), F.col("n"), _pieces(F.col("n"), k))).withColumn("w", _start(F.col("i") + 1, F.col("n"), _pieces(F.col("n"), k)) - F.col("at"))
        # Of the unchanged segments one has at most i edits before it and at most t - i behind it, so it is shifted by
        # i places at most, and as far from the length gap by the rest.
        t = bound(F.col("n"), k)
        low = F.greatest(F.lit(1), F.col("at") - F.col("i"), F.col("at") + F.col("gap") - (t - F.col("i")))
        high = F.least(F.col("at") + F.col("i"), F.col("at") + F.col("gap") + (t - F.col("i")), F.length("l") - F.col("w") + 1)
        probe = probe.where(high >= low).select("l", *other, "n", "gap", "i", "w", F.explode(F.sequence(low, high)).alias("p")).select("l", *other, "n", "gap", "i", F.substring(F.col("l"), F.col("p"), F.col("w")).alias("seg"))
        keys = lambda d: d.withColumn("key", F.xxhash64("n", "i", "seg"))
        met = keys(index).select("key", "s", *own, F.col("n").alias("m"), t.alias("t")).hint("merge").join(keys(probe).select("key", "l", *other, "n", "gap"), "key").where("m = n")
        # Of t edits at least gap are insertions, which lose no letter and one pair of letters of the shorter text.
        lost = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(F.col(b))))
        pairs_lost = lambda a, b: sum((lost(f"g{i}_{a}", f"g{i}_{b}") for i in range(1, _WORDS)), lost(f"g0_{a}", f"g0_{b}"))
        met = met.where((lost("sig_s", "sig_l") <= F.col("t") - F.col("gap")) & (lost("sig_l", "sig_s") <= F.col("t")) & (pairs_lost("s", "l") <= 2 * F.col("t") - F.col("gap")) & (pairs_lost("l", "s") <= 2 * F.col("t")))
        # Far pairs fall out before anything is shuffled to make the rest distinct.
        return met.where(F.call_function("levenshtein", F.col("s"), F.col("l"), F.col("t")) >= 0).select("s", "l").distinct()

    left = _signed(left)
    if right is None:
        met = one_way(left, left, False)
        pair = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
        both = F.when(F.length("s") < F.length("l"), F.array(pair("s", "l"), pair("l", "s"))).otherwise(F.array(pair("s", "l")))
        return met.select(F.explode(both).alias("p")).select("p.a", "p.b")
    right = _signed(right)
    first = one_way(left, right, False).select(F.col("s").alias("a"), F.col("l").alias("b"))
    second = one_way(right, left, True).select(F.col("l").alias("a"), F.col("s").alias("b"))
    return first.union(second)


def linked_pairs(books: DataFrame, symmetric: bool = False) -> DataFrame:
    """Cross-source pairs of books with a case: equal ISBNs or similar titles, by two exact blocks.

    Every case that says anything needs a common ISBN prefix or similar titles, so the blocks lose nothing.
    Titles are compared once per distinct pair. Records are joined by merging, since the estimates of their sizes are those
    of compressed files. Each unordered pair comes once, or twice with symmetric.
    """
    b = cut(books.withColumn("uid", F.concat_ws("|", "data_base", "id")))
    prefixes = b.select("uid", F.explode(F.array_distinct(F.transform("isbns", lambda i: F.substring(i, 1, 12)))).alias("p"))
    by_isbn = prefixes.toDF("u1", "p").hint("merge").join(prefixes.toDF("u2", "p"), "p").where("u1 < u2").select("u1", "u2")
    titles = b.select("title").where("title is not null").distinct()
    near = similar_texts(titles)
    ids = b.select("title", "uid")
    by_title = near.join(ids.toDF("a", "u1").hint("merge"), "a").join(ids.toDF("b", "u2").hint("merge"), "b").where("u1 < u2").select("u1", "u2")
    pairs = by_isbn.union(by_title).distinct()
    cols = ["uid", *BOOK]
    one, two = (b.select(*[F.col(c).alias(c + n) for c in cols]) for n in "12")
    met = pairs.join(one.hint("merge"), pairs.u1 == one.uid1).join(two.hint("merge"), pairs.u2 == two.uid2).where("data_base1 <> data_base2").drop("u1", "u2")
    met = met.withColumn("case", case_of(*[F.col(c) for c in ("title1", "title2", "isbns1", "isbns2", "authors1", "authors2")]))
    if not symmetric:
        return met
    back = met.select(*[F.col(c + {"1": "2", "2": "1"}[n]).alias(c + n) for n in "12" for c in cols], "case")
    return met.select(*back.columns).union(back)


def couples(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positive and negative couples out of cases; all others are dropped."""
    return pairs.where(F.col("case").isin("TITRE_AUTEUR_EQ", "ISBN_TITRE_EQ")), pairs.where(F.col("case") == "TITRE_EQ_AUTEUR_DIFF")


def flat_couples(pairs: DataFrame) -> DataFrame:
    """Couples as flat rows for CSV: lists as JSON, the case beside each record."""
    out = [F.to_json(c + n).alias(c + n) if c.endswith(("s", "s_raw")) and c != "data_base" else F.col(c + n) for n in "12" for c in BOOK]
    return pairs.select(*out, F.col("case").alias("cause1"), F.col("case").alias("cause2"))


def tiered(left: DataFrame, right: DataFrame, tiers: tuple[int, ...] = (8, 6, 4)) -> DataFrame:
    """(a, b, tier): pairs of distinct texts by the strictest tier they meet.

    Tier k holds d < max(1, m/k). A pair whose distance equals the bound of a stricter tier is in neither of
    the two bands beside it: the band of tier k starts beyond that bound.
    """
    met = similar_texts(left, right, max(1, min(tiers))).withColumn("d", F.levenshtein("a", "b")).withColumn("m", F.least(F.length("a"), F.length("b")))
    tier = None
    for i, k in enumerate(sorted(tiers, reverse=True)):
        inside = F.col("d") < F.greatest(F.lit(1.0), F.col("m") / float(k))
        if i:
            stricter = sorted(tiers, reverse=True)[i - 1]
            inside = inside & (F.col("d") > F.greatest(F.lit(1.0), F.col("m") / float(stricter)))
        tier = F.when(inside, k) if tier is None else tier.when(inside, k)
    return met.withColumn("tier", tier).where("tier is not null").select("a", "b", "d", "tier")


def tiered_raw(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, raw, d, tier): tiers 8, 6 and 4 where the two stricter ones measure the right text as it is written.

    left has a; right has b and raw, the written text of which b is the normal form. The bounds of tiers 8 and 6 take
    the length of raw in place of that of b; whatever they admit is also near by tier 4 in its normal form.
    """
    met = similar_texts(left.select("a").distinct(), right.select("b").distinct()).join(right.select("b", "raw").distinct().hint("merge"), "b").withColumn("d", F.levenshtein("a", "b"))
    written = F.least(F.length("a"), F.length("raw"))
    under = lambda m, k: F.col("d") < F.greatest(F.lit(1.0), m / float(k))
    over = lambda m, k: F.col("d") > F.greatest(F.lit(1.0), m / float(k))
    m = F.least(F.length("a"), F.length("b"))
    tier = F.when(under(written, 8), 8).when(under(written, 6) & over(written, 8), 6).when(under(m, 4) & over(m, 6), 4)
    return met.withColumn("tier", tier).where("tier is not null").select("a", "b", "raw", "d", "tier")


def confirmation(ours: Column, theirs: Column, raw: Column | None = None) -> Column:
    """confirmed if any of our titles is near any of theirs, infirmed if there are titles but none near, else unsure.

    With raw, a title of ours that stands in a raw text of theirs also confirms (an empty title always does).
    """
    near = F.exists(ours, lambda x: F.exists(theirs, lambda y: F.levenshtein(x, y) < F.greatest(F.lit(1.0), F.least(F.length(x), F.length(y)) / 4.0)))
    if raw is not None:
        near = near | F.exists(ours, lambda x: F.exists(raw, lambda y: text.normalize(y).contains(x)))
    return F.when(F.coalesce(near, F.lit(False)), "confirmed").when((F.size(theirs) > 0) & (F.size(ours) > 0), "infirmed").otherwise("unsure")


def confirmed(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(author_key, outcome): confirmation() over rows of titles, for authors of any number of books.

    ours has author_key, a (the name) and ours (an array of titles), theirs has a and t, one row per title. Near
    titles are found once over all distinct titles and brought back by name; no author's titles are paired with all others.
    """
    each = cut(ours.select("author_key", "a", F.explode("ours").alias("x")).distinct())
    near = similar_texts(each.select("x").distinct(), theirs.select("t").distinct()).toDF("x", "t")
    good = each.hint("merge").join(near, "x").join(theirs.hint("merge"), ["a", "t"]).select("author_key").distinct().withColumn("good", F.lit(True))
    named = theirs.select("a").distinct().withColumn("known", F.lit(True))
    rows = ours.join(named.hint("merge"), "a", "left").join(good.hint("merge"), "author_key", "left")
    return rows.select("author_key", F.when(F.col("good"), "confirmed").when(F.col("known") & (F.size("ours") > 0), "infirmed").otherwise("unsure").alias("outcome"))


def ile_books(works: DataFrame, authors: DataFrame) -> DataFrame:
    """Book records of works and authors that are kept apart: works name an author by author_uri, one row per author."""
    named = works.join(authors.select(F.col("uri").alias("author_uri"), "nom"), "author_uri", "left")
    whole = named.groupBy("id").agg(F.max("title").alias("title"), F.max("isbn").alias("isbn"), F.array_sort(F.collect_set("nom")).alias("noms"))
    return book(whole, F.col("id"), F.lit("ile"), F.col("title"), F.transform("noms", lambda n: text.swap_name(n)), F.array("isbn"), split_multi=True)


def deposit_books(lines: DataFrame) -> DataFrame:
    """Book records of the legal-deposit file: the title before its marks, authors and ISBNs of packed fields."""
    authors = F.transform(text.split_list(F.col("liste_auteur"), ";"), lambda n: text.swap_name(n))
    return book(lines, F.col("no_ligne"), F.lit("depot"), text.main_title(F.col("titre_publication")), authors, F.array("liste_isbn_nettoye"), split_multi=True)


def export_books(lines: DataFrame) -> DataFrame:
    """Book records of a publisher's export: names of contributors with a known role, the ISBNs of all forms."""
    names = F.filter(F.transform(text.split_list(F.col("contributeurs"), ","), text.contributor_name), lambda x: x != "")
    isbns = F.filter(F.array("isbn_papier", "isbn_pdf", "isbn_epub"), lambda x: F.coalesce(x, F.lit("")) != "")
    return book(lines, F.col("no_ligne"), F.lit("hurtubise"), F.col("titre"), names, isbns)


def page_books(pages: DataFrame) -> DataFrame:
    """Book records of crawled pages."""
    return book(pages, F.col("rec_id"), F.lit("babelio"), F.col("title"), F.transform("author", lambda x: text.swap_name(x)), F.when(F.col("ean").isNotNull(), F.array("ean")))


def graph_books(triples: DataFrame, source: str, title: str, author: str, isbn: str) -> DataFrame:
    """Book records out of triples, by the properties that hold title, authors and ISBNs."""
    from catalink.operators.graph import wide

    w = wide(triples, {"titles": title, "authors": author, "isbns": isbn})
    return book(w, F.col("s"), F.lit(source), F.get("titles", 0), F.col("authors"), F.col("isbns"))


def couples_by_name(left: DataFrame, right: DataFrame, name: str = "name") -> DataFrame:
    """(n): how many pairs of rows share a name; counts are multiplied, pairs are not made."""
    a, b = (x.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n" + s)) for x, s in ((left, "a"), (right, "b")))
    return a.join(b, name).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("n"))


def similarity(a: Column, b: Column) -> Column:
    """1 - d / length of the longer text, as the baseline matcher counts it."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def baseline_same(a: Column, b: Column, least: float = 0.66) -> Column:
    """Similar in capitals, or one text starts the other."""
    ua, ub = F.upper(a), F.upper(b)
    return (similarity(ua, ub) > least) | ua.startswith(ub) | ub.startswith(ua)


def _first_at(a: DataFrame, b: DataFrame, thresholds: list[int], batch: int) -> DataFrame:
    """(threshold, a, b): for each threshold the first pair (by texts) whose distance is exactly m / threshold.

    The texts of a come in their order, in batches of which each is three times as long as all before it, until every
    threshold has its pair or no text is left; a batch meets all of b whose length allows such a distance, by lengths.
    Pairs are compared, never kept, so where such pairs are usual little more than the first batch is worked through.
    """
    a = cut(numbered(a.toDF("a").where("length(a) > 0"), [F.col("a")], "place"))
    b = cut(b.toDF("b").where("length(b) > 0").select("b", F.length("b").alias("n")))
    total, done, open_ = a.count(), 0, set(thresholds)
    none = a.sparkSession.createDataFrame([], "threshold int, a string, b string")
    found = none
    while open_ and done < total:
        low = min(open_)
        n = F.length("a")
        # The shorter length is a multiple of the distance, and no text is longer than the other by more than that.
        ways = F.filter(F.sequence(n - F.floor(n / (low + 1)).cast("int"), n + F.floor(n / low).cast("int")), lambda k: F.exists(F.array(*[F.lit(t) for t in sorted(open_)]), lambda t: (F.least(n, k) % t == 0) & (F.abs(n - k) * t <= F.least(n, k))))
        some = a.where((F.col("place") > done) & (F.col("place") <= done + batch)).select("a", F.explode(ways).alias("n"))
        m = F.least(F.length("a"), F.col("n"))
        met = some.hint("merge").join(b, "n").select("a", "b", m.alias("m"), F.call_function("levenshtein", F.col("a"), F.col("b"), F.floor(m / low).cast("int")).alias("d")).where("d > 0")
        met = met.select("a", "b", F.explode(F.filter(F.array(*[F.lit(t) for t in sorted(open_)]), lambda t: F.col("d") * t == F.col("m"))).alias("threshold"))
        first = cut(met.groupBy("threshold").agg(F.min(F.struct("a", "b")).alias("x")).select("threshold", "x.a", "x.b"))
        # One row per threshold at most.
        open_ -= {r["threshold"] for r in first.select("threshold").collect()}
        found = found.union(first)
        done, batch = done + batch, 3 * (done + batch)
    return found


def threshold_examples(left: DataFrame, right: DataFrame, thresholds: tuple[int, ...] = tuple(range(2, 10)), k: int = 4, batch: int = 256) -> DataFrame:
    """For each threshold the first pair of distinct texts (by texts) whose distance is exactly m / threshold.

    Such a distance is below m / k for the thresholds over k: their pairs are among the similar texts. Those of the others
    are not, and far too many to be made; they are looked for in the order of the texts.
    """
    d = F.levenshtein("a", "b")
    m = F.least(F.length("a"), F.length("b"))
    strict, wide = [t for t in thresholds if t > k], [t for t in thresholds if 1 <= t <= k]
    found = _first_at(left, right, wide, batch)
    if strict:
        near = similar_texts(left, right, k)
        swept = near.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in strict]))).where((d * F.col("threshold") == m) & (d > 0))
        found = found.union(swept.groupBy("threshold").agg(F.min(F.struct("a", "b")).alias("x")).select("threshold", "x.a", "x.b"))
    return found


def first_per_case(pairs: DataFrame) -> DataFrame:
    """One example per case: the pair with the smallest ids."""
    return pairs.groupBy("case").agg(F.min(F.struct("uid1", "uid2")).alias("x"), F.count("*").alias("n")).select("case", "n", "x.uid1", "x.uid2")


def author_index(books: DataFrame, column: str = "authors") -> DataFrame:
    """(author, uid, n_books): one row per book of an author, with how many there are; no author's books meet in one row."""
    each = cut(books.select(F.explode(F.array_distinct(column)).alias("author"), F.concat_ws("|", "data_base", "id").alias("uid")))
    return each.join(each.groupBy("author").agg(F.count("*").alias("n_books")), "author").select("author", "uid", "n_books")


def missing_authors(books: DataFrame) -> DataFrame:
    """Books without author that share an ISBN with books that have some, with the authors found."""
    b = books.withColumn("uid", F.concat_ws("|", "data_base", "id"))
    each = b.select("uid", "authors", F.explode("isbns").alias("isbn"))
    lack, have = each.where(F.size("authors") == 0).select("uid", "isbn"), each.where(F.size("authors") > 0).select("isbn", F.explode("authors").alias("author"))
    return lack.join(have, "isbn").groupBy("uid").agg(F.array_join(F.array_sort(F.collect_set("author")), ";").alias("found"))
