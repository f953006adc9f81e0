"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalink.functions import text
from catalink.operators import align, graph, match, mlprep, profile
from catalink.plans import split_queries
from catalink.plans import sqltext as q
from catalink.plans.registry import QUERIES, SQL, query
from catalink.runtime import cut, read

QUERIES |= split_queries.QUERIES
SQL |= split_queries.SQL


def _books(spark: SparkSession, d: str) -> DataFrame:
    return match.library_books(read(spark, d, "livre"), read(spark, d, "babelio_book"))


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    return align.align(align.isbn_titles(_books(spark, d)))


# --- linkage --------------------------------------------------------------------------------------------------

_CASE = """CASE WHEN isbn = 'NEQ' AND eq AND who = 'NOINFO' THEN 'ISBN_DIFF_TITRE_EQ' WHEN isbn = 'NEQ' AND eq AND who = 'EQ' THEN 'ISBN_DIFF_TITRE_AUTEUR_EQ'
  WHEN isbn = 'EQ' AND eq THEN 'ISBN_TITRE_EQ' WHEN isbn = 'EQ' AND NOT far THEN 'ISBN_EQ_TITRE_DIFF' WHEN isbn = 'EQ' THEN 'ISBN_EQ_TITRE_T_DIFF'
  WHEN isbn = 'NOINFO' AND eq AND who = 'NEQ' THEN 'TITRE_EQ_AUTEUR_DIFF' WHEN isbn = 'NOINFO' AND eq AND who = 'NOINFO' THEN 'TITRE_EQ'
  WHEN isbn = 'NOINFO' AND eq AND who = 'EQ' THEN 'TITRE_AUTEUR_EQ' ELSE 'PAS_INFO' END"""
_PAIRS = f"""WITH {q.BOOKS},
{q.odd_signs('SELECT title t FROM books')},
b AS MATERIALIZED (SELECT uid, data_base, {q.one_byte('title')} t, isbns, list_transform(isbns, lambda x: left(x, 12)) p, flatten(list_transform(authors, lambda x: string_split(x, ' '))) w, authors FROM books),
pairs AS (SELECT l.uid u1, r.uid u2, l.t t1, r.t t2, levenshtein(l.t, r.t) d, least(length(l.t), length(r.t)) m,
    CASE WHEN len(l.isbns) = 0 OR len(r.isbns) = 0 THEN 'NOINFO' WHEN list_has_any(l.p, r.p) THEN 'EQ' ELSE 'NEQ' END isbn,
    CASE WHEN len(l.authors) = 0 OR len(r.authors) = 0 THEN 'NOINFO' WHEN list_has_any(l.w, r.w) THEN 'EQ' ELSE 'NEQ' END who
  FROM b l JOIN b r ON l.uid < r.uid AND l.data_base <> r.data_base WHERE l.t IS NOT NULL AND r.t IS NOT NULL),
judged AS (SELECT *, d < greatest(1, m / 4) eq, d >= m / 2 far FROM pairs),
cased AS (SELECT u1, u2, {_CASE} "case" FROM judged WHERE isbn = 'EQ' OR eq)
"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return match.linked_pairs(_books(spark, d))


@query(_PAIRS + 'SELECT "case", count(*) n FROM cased GROUP BY 1')
def linkage_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cross-source pairs of all books, counted by case."""
    return _pairs(spark, d).groupBy("case").agg(F.count("*").alias("n"))


@query(_PAIRS + """SELECT u1, u2, "case" FROM cased WHERE "case" IN ('TITRE_AUTEUR_EQ', 'ISBN_TITRE_EQ', 'TITRE_EQ_AUTEUR_DIFF')""")
def linkage_couples(spark: SparkSession, d: str) -> DataFrame:
    """Positive and negative couples."""
    good, bad = match.couples(_pairs(spark, d))
    return good.union(bad).select(F.col("uid1").alias("u1"), F.col("uid2").alias("u2"), "case")


@query(_PAIRS + """SELECT "case", count(*) n, arg_min(u1, u1 || '#' || u2) uid1, split_part(min(u1 || '#' || u2), '#', 2) uid2 FROM cased GROUP BY 1""")
def case_examples(spark: SparkSession, d: str) -> DataFrame:
    return match.first_per_case(_pairs(spark, d))


_TITLES = f"""{q.odd_signs(f"SELECT {q.normal('title')} t FROM babelio_book UNION SELECT {q.normal('titre')} FROM livre")},
a AS MATERIALIZED (SELECT DISTINCT {q.normal('title')} a FROM babelio_book WHERE title IS NOT NULL), xa AS MATERIALIZED (SELECT a, {q.one_byte('a')} x FROM a),
b AS MATERIALIZED (SELECT DISTINCT {q.normal('titre')} b FROM livre WHERE titre IS NOT NULL), xb AS MATERIALIZED (SELECT b, {q.one_byte('b')} y FROM b),
p AS (SELECT a, b, x, y, levenshtein(x, y) d, least(length(a), length(b)) m FROM xa, xb WHERE abs(length(a) - length(b)) <= 1 + length(a) / 3)"""


def _titles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = read(spark, d, "babelio_book").where("title is not null").select(text.normalize(F.col("title")).alias("a")).distinct()
    b = read(spark, d, "livre").where("titre is not null").select(text.normalize(F.col("titre")).alias("b")).distinct()
    return a, b


@query(f"WITH {_TITLES} SELECT * FROM (SELECT a, b, d, CASE WHEN d < greatest(1, m / 8) THEN 8 WHEN d < greatest(1, m / 6) AND d > greatest(1, m / 8) THEN 6 WHEN d < greatest(1, m / 4) AND d > greatest(1, m / 6) THEN 4 END tier FROM p) WHERE tier IS NOT NULL")
def title_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Distinct titles of pages and notices by the strictest tier of similarity."""
    return match.tiered(*_titles(spark, d))


@query(f"WITH {_TITLES} SELECT d, count(*) n FROM p WHERE d < greatest(1, m / 4) GROUP BY 1")
def distance_histogram(spark: SparkSession, d: str) -> DataFrame:
    near = match.similar_texts(*_titles(spark, d))
    return near.groupBy(F.levenshtein("a", "b").alias("d")).agg(F.count("*").alias("n"))


@query(f"""WITH {_TITLES}, s AS (SELECT t threshold, min(a || chr(1) || b) x FROM (SELECT *, unnest(range(2, 10)) t FROM p WHERE d < greatest(1, m / 4)) WHERE d * t = m AND d > 0 GROUP BY 1)
SELECT CAST(threshold AS INT) threshold, split_part(x, chr(1), 1) a, split_part(x, chr(1), 2) b FROM s""")
def threshold_examples(spark: SparkSession, d: str) -> DataFrame:
    return match.threshold_examples(*_titles(spark, d))


@query(f"WITH {q.BOOKS} SELECT author, uid, count(*) OVER (PARTITION BY author) n_books FROM (SELECT uid, unnest(list_distinct(authors)) author FROM books)")
def author_index(spark: SparkSession, d: str) -> DataFrame:
    return match.author_index(_books(spark, d))


@query(f"WITH {q.BOOKS} SELECT title, max(len(isbns)) n FROM books GROUP BY 1")
def most_isbns_by_title(spark: SparkSession, d: str) -> DataFrame:
    return _books(spark, d).groupBy("title").agg(F.max(F.size("isbns")).alias("n"))


@query(f"""WITH {q.BOOKS}, e AS (SELECT uid, authors, unnest(isbns) isbn FROM books)
SELECT l.uid, array_to_string(list_sort(list_distinct(list(r.author))), ';') found FROM e l JOIN (SELECT isbn, unnest(authors) author FROM e) r USING (isbn) WHERE len(l.authors) = 0 GROUP BY 1""")
def missing_authors(spark: SparkSession, d: str) -> DataFrame:
    return match.missing_authors(_books(spark, d))


_AUTH = rf"""ours AS (SELECT author_key, name n, list_transform(coalesce(bibliography, []), lambda x: {q.normal('x')}) ours FROM babelio_author),
each AS (SELECT {q.normal('titre')} t, unnest(auteurs) a FROM livre WHERE titre IS NOT NULL),
{q.odd_signs('SELECT unnest(ours) t FROM ours UNION SELECT t FROM each')},
theirs AS (SELECT {q.author(q.swapped('a'))} a, list_distinct(list(t)) theirs FROM each GROUP BY 1)"""


@query(f"""WITH {_AUTH}, j AS (SELECT author_key, ours, coalesce(theirs, []) theirs FROM ours LEFT JOIN theirs ON {q.author(q.swapped('n'))} = a),
m AS (SELECT DISTINCT author_key FROM (SELECT author_key, x, unnest(theirs) y FROM (SELECT author_key, unnest(ours) x, theirs FROM j)) WHERE levenshtein({q.one_byte('x')}, {q.one_byte('y')}) < greatest(1, least(length(x), length(y)) / 4))
SELECT author_key, CASE WHEN author_key IN (SELECT author_key FROM m) THEN 'confirmed' WHEN len(ours) > 0 AND len(theirs) > 0 THEN 'infirmed' ELSE 'unsure' END outcome FROM j""")
def author_confirmation(spark: SparkSession, d: str) -> DataFrame:
    """Author pages against the notices under the same name: confirmed, infirmed or unsure by their titles."""
    name = lambda c: text.normalize_author(text.swap_name(F.col(c))).alias("a")
    ours = cut(read(spark, d, "babelio_author").select("author_key", name("name"), F.coalesce(F.transform("bibliography", text.normalize), F.array().cast("array<string>")).alias("ours")))
    theirs = cut(read(spark, d, "livre").where("titre is not null").select(text.normalize(F.col("titre")).alias("t"), F.explode("auteurs").alias("raw")).select(name("raw"), "t").distinct())
    return match.confirmed(ours, theirs)


# --- text -----------------------------------------------------------------------------------------------------


@query(f"SELECT id_livre, {q.normal('titre')} title, {q.fixed('titre', 'alignment')} mended FROM livre")
def norm_title(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "livre").select("id_livre", text.normalize(F.col("titre")).alias("title"), text.fix_mojibake(F.col("titre"), "alignment").alias("mended"))


@query(f"SELECT DISTINCT a raw, {q.author('a')} name, {q.swapped('a')} swapped FROM (SELECT unnest(auteurs) a FROM livre) WHERE a IS NOT NULL")
def norm_author(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "livre").select(F.explode("auteurs").alias("raw")).where("raw is not null").distinct()
    return a.select("raw", text.normalize_author(F.col("raw")).alias("name"), text.swap_name(F.col("raw")).alias("swapped"))


@query(f"SELECT id_livre, i raw, {q.isbn('i')} isbn, {q.isbn_key(q.no_parens('i'))} key FROM (SELECT id_livre, unnest(isbn) i FROM livre)")
def norm_isbn(spark: SparkSession, d: str) -> DataFrame:
    i = read(spark, d, "livre").select("id_livre", F.explode("isbn").alias("raw"))
    return i.select("id_livre", "raw", text.normalize_isbn(F.col("raw")).alias("isbn"), text.format_isbn(text.strip_parens(F.col("raw"))).alias("key"))


@query(r"SELECT no_ligne, i isbn FROM (SELECT no_ligne, unnest(list_filter(list_transform(string_split_regex(liste_isbn_nettoye, '[|;,]'), lambda x: trim(x)), lambda x: x <> '')) i FROM depotlegal20171231)")
def split_isbns(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "depotlegal20171231").select("no_ligne", F.explode(text.split_isbns(F.col("liste_isbn_nettoye"))).alias("isbn"))


@query(r"SELECT g AS \"group\", count(*) n FROM (SELECT unnest(regexp_extract_all(titre, '\([^()]*\)')) g FROM (SELECT DISTINCT titre FROM livre)) GROUP BY 1".replace('\\"', '"'))
def paren_texts(spark: SparkSession, d: str) -> DataFrame:
    return profile.paren_texts(read(spark, d, "livre"), "titre")


@query(r"""SELECT rec_id, nullif(regexp_extract(infos, '\((\d{0,2}/?\d{0,2}/?\d{4})\)', 1), '') edition_date, nullif(regexp_extract(infos, 'EAN[ :]+([\d-]+)', 1), '') ean, nullif(regexp_extract(infos, '[ ]*([\d]+) pages', 1), '') nb_pages FROM babelio_book""")
def book_info_fields(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "babelio_book").select("rec_id", *[text.info_field(F.col("infos"), n).alias(n) for n in ("edition_date", "ean", "nb_pages")])


_PERSON_FIELDS = ("nationnality", "place_of_birth", "country_of_birth", "date_of_birth", "place_of_death", "country_of_death", "date_of_death")


@query("SELECT author_key, " + ", ".join(f"nullif(regexp_extract(infos, {q.quote(text.INFO_PATTERNS[n])}, 1), '') {n}" for n in _PERSON_FIELDS) + " FROM babelio_author")
def author_info_fields(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "babelio_author").select("author_key", *[text.info_field(F.col("infos"), n).alias(n) for n in _PERSON_FIELDS])


@query(r"""SELECT rec_id, t.tag, nullif(regexp_extract(t.info || ' ', 'tag_t([\d]+) ', 1), '') importance FROM (SELECT rec_id, unnest(tags) t FROM babelio_book)""")
def tag_importance(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "babelio_book").select("rec_id", F.explode("tags").alias("t")).select("rec_id", "t.tag", text.info_field(F.concat("t.info", F.lit(" ")), "importance").alias("importance"))


@query(f"""SELECT no_ligne, split_part(split_part(titre_publication, ' / ', 1), ' : ', 1) title, CASE WHEN trim(coalesce(langue_originale, '')) = '' THEN langue_publication ELSE langue_originale END original,
  CASE left(sujet, 5) {' '.join(f"WHEN {q.quote(k)} THEN {q.quote(v)}" for k, v in text.GENRES.items())} END genre FROM depotlegal20171231""")
def deposit_fields(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "depotlegal20171231")
    original = F.when(F.trim(F.coalesce("langue_originale", F.lit(""))) == "", F.col("langue_publication")).otherwise(F.col("langue_originale"))
    return r.select("no_ligne", text.main_title(F.col("titre_publication")).alias("title"), original.alias("original"), text.genre(F.col("sujet")).alias("genre"))


@query(f"SELECT no_ligne, CASE langue {' '.join(f'WHEN {q.quote(k)} THEN {q.quote(v)}' for k, v in text.LANGUAGES.items())} END code FROM exportation_hurtubise")
def language_codes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "exportation_hurtubise").select("no_ligne", text.lookup(F.col("langue"), text.LANGUAGES).alias("code"))


_ROLE_AT = "coalesce(" + ", ".join(f"nullif(strpos(p, {q.quote(r)}), 0)" for r, _ in text.ROLES) + ")"


@query(f"""WITH e AS (SELECT no_ligne, pos, trim(p) p FROM (SELECT no_ligne, unnest(l) p, generate_subscripts(l, 1) - 1 pos FROM (SELECT no_ligne, list_filter(list_transform(string_split(coalesce(contributeurs, ''), ','), lambda x: trim(x, ' ')), lambda x: x <> '') l FROM exportation_hurtubise))),
n AS (SELECT no_ligne, pos, left(p, greatest(a - 2, 0)) name, substr(p, a) role FROM (SELECT *, {_ROLE_AT} a FROM e) WHERE a IS NOT NULL)
SELECT no_ligne, CAST(pos AS INT) pos, name, role, CASE role {' '.join(f'WHEN {q.quote(r)} THEN {q.quote(p)}' for r, p in text.ROLES)} END property, CASE WHEN name = 'Collectif' THEN '_:' || no_ligne || '-' || pos END node FROM n WHERE name <> ''""")
def contributor_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.contributor_edges(read(spark, d, "exportation_hurtubise"), "no_ligne", "contributeurs")


@query("SELECT DISTINCT url, list_filter(string_split(url, '/'), lambda x: x <> '')[-1] tail FROM babelio_author")
def uri_tails(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "babelio_author").select("url", text.uri_tail(F.col("url")).alias("tail")).distinct()


@query("SELECT nom_editeur, row_number() OVER (ORDER BY nom_editeur) id FROM (SELECT DISTINCT nom_editeur FROM depotlegal20171231 WHERE nom_editeur IS NOT NULL)")
def surrogate_ids(spark: SparkSession, d: str) -> DataFrame:
    """Publishers with ids in order of their names."""
    names = read(spark, d, "depotlegal20171231").select("nom_editeur").where("nom_editeur is not null").distinct()
    return mlprep.numbered(names, [F.col("nom_editeur")], "id")


# --- alignment ------------------------------------------------------------------------------------------------

_AL = f"WITH {q.BOOKS}, {q.ALIGNED} "


@query(_AL + "SELECT isbn, adp, ile, depot, hurtubise, babelio FROM counted WHERE (n_sources * (n_sources - 1) // 2 - (adp IS NOT NULL AND babelio IS NOT NULL)::INT) % 2 = 1")
def isbn_parity(spark: SparkSession, d: str) -> DataFrame:
    return align.overlapping(_aligned(spark, d), "parity")


@query(_AL + "SELECT isbn, adp, ile, depot, hurtubise, babelio FROM counted WHERE n_sources >= 2")
def isbn_overlap(spark: SparkSession, d: str) -> DataFrame:
    return align.overlapping(_aligned(spark, d), "any_overlap")


@query(_AL + "SELECT s AS source, n FROM (SELECT count(adp) adp, count(ile) ile, count(depot) depot, count(hurtubise) hurtubise, count(babelio) babelio FROM counted) UNPIVOT (n FOR s IN (adp, ile, depot, hurtubise, babelio))")
def isbn_coverage(spark: SparkSession, d: str) -> DataFrame:
    return align.coverage(_aligned(spark, d))


@query(_AL + "SELECT n_sources, count(*) n FROM counted GROUP BY 1")
def overlap_degrees(spark: SparkSession, d: str) -> DataFrame:
    return align.degrees(_aligned(spark, d))


@query(_AL + "SELECT concat_ws('+', CASE WHEN adp IS NOT NULL THEN 'adp' END, CASE WHEN ile IS NOT NULL THEN 'ile' END, CASE WHEN depot IS NOT NULL THEN 'depot' END, CASE WHEN hurtubise IS NOT NULL THEN 'hurtubise' END, CASE WHEN babelio IS NOT NULL THEN 'babelio' END) sources, count(*) n FROM counted GROUP BY 1")
def source_combinations(spark: SparkSession, d: str) -> DataFrame:
    return align.combinations(_aligned(spark, d))


@query(_AL + "SELECT a.data_base source1, b.data_base source2, count(*) n FROM keyed a JOIN keyed b USING (isbn) WHERE a.data_base < b.data_base GROUP BY 1, 2")
def source_intersections(spark: SparkSession, d: str) -> DataFrame:
    return align.intersections(align.isbn_titles(_books(spark, d)))


@query(_AL + ", t AS (SELECT isbn, unnest([adp, ile, depot, hurtubise, babelio]) t FROM aligned), u AS (SELECT DISTINCT isbn, t FROM t WHERE t IS NOT NULL) SELECT a.isbn, a.t title1, b.t title2 FROM u a JOIN u b USING (isbn) WHERE a.t < b.t")
def positive_pairs(spark: SparkSession, d: str) -> DataFrame:
    return align.positive_pairs(_aligned(spark, d))


# --- profiling ------------------------------------------------------------------------------------------------


@query("""WITH u AS (SELECT path, value, count(*) n FROM ((SELECT COLUMNS(*)::VARCHAR FROM depotlegal20171231) UNPIVOT INCLUDE NULLS (value FOR path IN (COLUMNS(*)))) WHERE path NOT IN ('no_ligne', 'recu_le') GROUP BY 1, 2),
f AS (SELECT *, sum(CASE WHEN coalesce(value, '') <> '' THEN n ELSE 0 END) OVER (PARTITION BY path) non_null, row_number() OVER (PARTITION BY path ORDER BY n DESC, value NULLS FIRST) rank FROM u)
SELECT path, CASE WHEN length(value) > 100 THEN left(value, 75) || '..' ELSE value END value, n, CAST(non_null AS BIGINT) non_null, CAST(rank AS INT) rank FROM f WHERE rank <= 10""")
def table_profile(spark: SparkSession, d: str) -> DataFrame:
    """Every column of the legal-deposit file with its ten most frequent values."""
    r = read(spark, d, "depotlegal20171231").drop("no_ligne", "recu_le")
    return profile.top_values(profile.column_values(r)).select("path", "value", "n", "non_null", "rank")


@query("""WITH e AS (
  SELECT 'feed' path, feed value FROM babelio_book UNION ALL SELECT 'author', unnest(author) FROM babelio_book
  UNION ALL SELECT 'tags.tag', t.tag FROM (SELECT unnest(tags) t FROM babelio_book) UNION ALL SELECT 'tags.importance', t.importance FROM (SELECT unnest(tags) t FROM babelio_book) UNION ALL SELECT 'tags.info', t.info FROM (SELECT unnest(tags) t FROM babelio_book)
  UNION ALL SELECT 'reviews.rating', r.rating FROM (SELECT unnest(reviews) r FROM babelio_book) UNION ALL SELECT 'reviews.author', unnest(r.author) FROM (SELECT unnest(reviews) r FROM babelio_book)
  UNION ALL SELECT 'reviews.id', r.id FROM (SELECT unnest(reviews) r FROM babelio_book) UNION ALL SELECT 'reviews.date', r.date FROM (SELECT unnest(reviews) r FROM babelio_book)
  UNION ALL SELECT 'reviews.pop', r.pop FROM (SELECT unnest(reviews) r FROM babelio_book) UNION ALL SELECT 'reviews.content', r.content FROM (SELECT unnest(reviews) r FROM babelio_book))
SELECT path, value, count(*) n FROM e WHERE value <> '' GROUP BY 1, 2""")
def item_profile(spark: SparkSession, d: str) -> DataFrame:
    """Value frequencies of nested items."""
    return profile.nested_values(read(spark, d, "babelio_book"), ["feed", "author", "tags", "reviews"])


@query("SELECT event_type property, round(avg(n), 6) non_null_mean, count(*) nb_non_null, CAST(sum(n) AS BIGINT) total FROM (SELECT event_type, user_id, count(*) n FROM events GROUP BY 1, 2) GROUP BY 1")
def property_summary(spark: SparkSession, d: str) -> DataFrame:
    return profile.property_summary(read(spark, d, "events"), "user_id", "event_type")


@query("SELECT count(n_chars) n, count(*) FILTER (n_chars IS NULL) n_null, round(avg(n_chars), 6) mean, round(median(n_chars), 6) median, round(stddev_pop(n_chars), 6) pstdev, CAST(max(n_chars) AS DOUBLE) max, CAST(min(n_chars) FILTER (n_chars > 0) AS DOUBLE) min_non_zero FROM documents")
def length_statistics(spark: SparkSession, d: str) -> DataFrame:
    return profile.describe(read(spark, d, "documents"), F.col("n_chars"))


@query("SELECT try_cast(rating AS DOUBLE) AS value, count(*) n FROM babelio_book GROUP BY 1")
def rating_histogram(spark: SparkSession, d: str) -> DataFrame:
    return profile.histogram(read(spark, d, "babelio_book"), F.expr("try_cast(rating as double)"))


@query("SELECT coalesce(len(reviews), 0) size, count(*) n FROM babelio_book GROUP BY 1")
def reviews_per_book(spark: SparkSession, d: str) -> DataFrame:
    return profile.list_sizes(read(spark, d, "babelio_book"), "reviews")


@query("""(SELECT doc_id AS key, n_chars AS value, 'top' side FROM documents WHERE n_chars IS NOT NULL ORDER BY n_chars DESC, doc_id LIMIT 10)
UNION ALL (SELECT doc_id, n_chars, 'bottom' FROM documents WHERE n_chars > 0 ORDER BY n_chars, doc_id LIMIT 10)""")
def length_extremes(spark: SparkSession, d: str) -> DataFrame:
    return profile.extremes(read(spark, d, "documents"), "doc_id", F.col("n_chars"))


@query("""SELECT concat_ws('+', CASE WHEN date_of_birth IS NOT NULL THEN 'born' END, CASE WHEN date_of_death IS NOT NULL THEN 'died' END, CASE WHEN coalesce(bio, '') <> '' THEN 'bio' END, CASE WHEN len(awards) > 0 THEN 'awards' END) combination, count(*) n FROM babelio_author GROUP BY 1""")
def presence_counts(spark: SparkSession, d: str) -> DataFrame:
    flags = {"born": F.col("date_of_birth").isNotNull(), "died": F.col("date_of_death").isNotNull(), "bio": F.coalesce("bio", F.lit("")) != "", "awards": F.size("awards") > 0}
    return profile.presence_counts(read(spark, d, "babelio_author"), flags)


@query(f"SELECT name, count(*) n FROM (SELECT {q.author(q.swapped('name'))} AS name FROM babelio_author WHERE name IS NOT NULL) GROUP BY 1 HAVING count(*) > 1")
def homonyms(spark: SparkSession, d: str) -> DataFrame:
    named = read(spark, d, "babelio_author").select(text.normalize_author(text.swap_name(F.col("name"))).alias("name"))
    return profile.homonyms(named, "name")


@query("""WITH f AS (SELECT event_type, count(*) n, row_number() OVER (ORDER BY count(*) DESC, event_type) r FROM events GROUP BY 1) SELECT event_type, n FROM f WHERE r <= 3""")
def top_events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("SELECT url, arg_max(rec_id, (crawled_at, rec_id)) rec_id FROM babelio_book WHERE crawled_at IS NOT NULL GROUP BY 1")
def last_crawl(spark: SparkSession, d: str) -> DataFrame:
    """Last one wins per page, by time and id."""
    return read(spark, d, "babelio_book").where("crawled_at is not null").groupBy("url").agg(F.max_by("rec_id", F.struct("crawled_at", "rec_id")).alias("rec_id"))


_WRITERS = rf"""a AS (SELECT name, arg_min(birth, author_key) birth, count(*) n FROM (SELECT author_key, {q.author(q.swapped('name'))} AS name, coalesce(nullif(regexp_extract(coalesce(date_of_birth, ''), '(\d{{4}})$', 1), ''), 'X') birth FROM babelio_author WHERE name IS NOT NULL) GROUP BY 1),
b AS (SELECT name, arg_min(birth, auteur_key) birth, count(*) n FROM (SELECT auteur_key, {q.author("trim(coalesce(prenom, '') || ' ' || coalesce(nom, ''))")} AS name, coalesce(nullif(regexp_extract(coalesce(annee_naissance, ''), '^(\d{{4}})$', 1), ''), 'X') birth FROM auteur) GROUP BY 1)"""


@query(f"WITH {_WRITERS} SELECT coalesce(a.name, b.name) AS name, coalesce(nullif(a.birth, 'X'), b.birth, 'X') birth, a.n pages, b.n notices FROM a FULL JOIN b ON a.name = b.name")
def writers_merged(spark: SparkSession, d: str) -> DataFrame:
    """Author pages and notices merged by name; of homonyms the first by key speaks, the notice where the page has no birth year."""
    year = lambda c, p: F.coalesce(F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), p, 1), F.lit("")), F.lit("X"))
    a = read(spark, d, "babelio_author").where("name is not null").select("author_key", text.normalize_author(text.swap_name(F.col("name"))).alias("name"), year(F.col("date_of_birth"), r"(\d{4})$").alias("birth"))
    b = read(spark, d, "auteur").select("auteur_key", text.normalize_author(F.trim(F.concat(F.coalesce("prenom", F.lit("")), F.lit(" "), F.coalesce("nom", F.lit(""))))).alias("name"), year(F.col("annee_naissance"), r"^(\d{4})$").alias("birth"))
    a = a.groupBy("name").agg(F.min_by("birth", "author_key").alias("birth_a"), F.count("*").alias("pages"))
    b = b.groupBy("name").agg(F.min_by("birth", "auteur_key").alias("birth_b"), F.count("*").alias("notices"))
    return a.join(b, "name", "full").select("name", F.coalesce(F.nullif("birth_a", F.lit("X")), "birth_b", F.lit("X")).alias("birth"), "pages", "notices")


# --- graphs ---------------------------------------------------------------------------------------------------

_NS = "https://schema.org/"
_T = f"""t AS (SELECT DISTINCT s, p, o FROM (
  SELECT 'livre/' || id_livre s, '{graph.RDF_TYPE}' p, '{_NS}Book' o FROM livre UNION ALL SELECT 'livre/' || id_livre, '{_NS}name', titre FROM livre
  UNION ALL SELECT 'livre/' || id_livre, '{_NS}isbn', unnest(isbn) FROM livre UNION ALL SELECT 'livre/' || id_livre, '{_NS}author', unnest(auteurs) FROM livre
  UNION ALL SELECT 'livre/' || id_livre, '{_NS}publisher', editeur FROM livre) WHERE o <> '')"""


def _triples(spark: SparkSession, d: str) -> DataFrame:
    properties = [(graph.RDF_TYPE, F.lit(_NS + "Book"), "uri", None, None), (_NS + "name", F.col("titre"), "literal", None, "fr"), (_NS + "isbn", F.col("isbn"), "literal", None, None), (_NS + "author", F.col("auteurs"), "literal", None, None), (_NS + "publisher", F.col("editeur"), "literal", None, None)]
    return graph.emit(read(spark, d, "livre"), F.concat(F.lit("livre/"), F.col("id_livre").cast("string")), properties)


@query(f"WITH {_T} SELECT s, p, o FROM t")
def triples(spark: SparkSession, d: str) -> DataFrame:
    return _triples(spark, d).select("s", "p", "o")


@query(f"WITH {_T} SELECT DISTINCT a.s, a.o title, b.o isbn, c.o publisher FROM t a JOIN t b ON a.s = b.s AND b.p = '{_NS}isbn' LEFT JOIN t c ON a.s = c.s AND c.p = '{_NS}publisher' WHERE a.p = '{_NS}name'")
def graph_star(spark: SparkSession, d: str) -> DataFrame:
    return graph.star(_triples(spark, d), {"title": _NS + "name", "isbn": _NS + "isbn"}, {"publisher": _NS + "publisher"}, cls=_NS + "Book")


@query(f"WITH {_T} SELECT s, coalesce(array_to_string(list_sort(list(o) FILTER (p = '{_NS}author')), ';'), '') authors, coalesce(array_to_string(list_sort(list(o) FILTER (p = '{_NS}isbn')), ';'), '') isbns FROM t GROUP BY 1")
def graph_records(spark: SparkSession, d: str) -> DataFrame:
    w = graph.wide(_triples(spark, d), {"authors": _NS + "author", "isbns": _NS + "isbn"})
    return w.select("s", F.array_join("authors", ";").alias("authors"), F.array_join("isbns", ";").alias("isbns"))


@query(f"WITH {_T} SELECT p, o, count(*) n FROM t WHERE o <> '{_NS}Book' GROUP BY 1, 2")
def graph_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.graph_counts(_triples(spark, d), _NS + "Book")[1]


def _places(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and customers as one tree of codes."""
    r = read(spark, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("code"), F.col("r_name").alias("label"), F.lit(None).cast("string").alias("parent"))
    n = read(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey"), "n_name", F.concat(F.lit("R"), "n_regionkey"))
    c = read(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey"), "c_name", F.concat(F.lit("N"), "c_nationkey"))
    return r.union(n).union(c)


_PLACES = "places AS (SELECT 'R' || r_regionkey code, r_name AS label, NULL parent FROM region UNION ALL SELECT 'N' || n_nationkey, n_name, 'R' || n_regionkey FROM nation UNION ALL SELECT 'C' || c_custkey, c_name, 'N' || c_nationkey FROM customer)"


@query(f"WITH RECURSIVE {_PLACES}, c AS (SELECT parent ancestor, code descendant, 1 steps FROM places WHERE parent IS NOT NULL UNION SELECT c.ancestor, p.code, c.steps + 1 FROM c JOIN places p ON p.parent = c.descendant) SELECT * FROM c")
def taxonomy_closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(_places(spark, d), "parent", "code")


@query(f"WITH RECURSIVE {_PLACES}, c AS (SELECT code, 'ROOT/' || code AS path, 1 AS level FROM places WHERE parent IS NULL UNION ALL SELECT p.code, c.path || '/' || p.code, c.level + 1 FROM c JOIN places p ON p.parent = c.code) SELECT code, path, level FROM c")
def taxonomy_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.taxonomy_paths(_places(spark, d), "code", "parent")


@query(f"""WITH {_PLACES} SELECT DISTINCT * FROM (SELECT 'x:' || code s, 'http://www.w3.org/2000/01/rdf-schema#label' p, code o, 'literal' o_kind, NULL::VARCHAR o_lang FROM places
UNION ALL SELECT 'x:' || code, 'http://www.w3.org/2004/02/skos/core#prefLabel', code || ' - ' || label, 'literal', 'fr' FROM places UNION ALL SELECT 'x:' || coalesce(parent, 'ROOT'), 'http://www.w3.org/2004/02/skos/core#narrower', 'x:' || code, 'uri', NULL FROM places)""")
def skos_triples(spark: SparkSession, d: str) -> DataFrame:
    return graph.skos(_places(spark, d), "code", "label", "parent", "x:")


@query("SELECT DISTINCT author_db.author_key k, author_db.name AS name FROM couple_writers WHERE author_db.author_key IS NOT NULL AND author_db.author_key NOT IN (SELECT author_db.author_key FROM couple_writers WHERE nb_books > 1 AND author_db.author_key IS NOT NULL)")
def unknown_authors(spark: SparkSession, d: str) -> DataFrame:
    """Authors that no couple of several books knows, by an anti join."""
    c = read(spark, d, "couple_writers")
    return c.select(F.col("author_db.author_key").alias("k"), F.col("author_db.name").alias("name")).where("k is not null").distinct().join(c.where("nb_books > 1").select(F.col("author_db.author_key").alias("k")), "k", "left_anti")


@query("""SELECT author_db.data_base AS data_base, count(*) couples, count(DISTINCT author_db.author_key) authors, round(count(*) / count(DISTINCT author_db.author_key), 6) per_author FROM couple_writers WHERE author_db.author_key IS NOT NULL GROUP BY 1""")
def match_statistics(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "couple_writers").select("author_db.*").where("author_key is not null")
    return c.groupBy("data_base").agg(F.count("*").alias("couples"), F.count_distinct("author_key").alias("authors")).withColumn("per_author", F.round(F.col("couples") / F.col("authors"), 6))


# --- learning -------------------------------------------------------------------------------------------------


@query("SELECT label, CAST(i AS INT) i, round(avg(x), 6) mean FROM (SELECT label, unnest(embedding) x, generate_subscripts(embedding, 1) - 1 i FROM embeddings) GROUP BY 1, 2")
def embedding_means(spark: SparkSession, d: str) -> DataFrame:
    return mlprep.group_means(read(spark, d, "embeddings"), "label", "embedding")


_CH = f"list_filter(string_split(lower(translate(text, {q.quote(mlprep.FILTERED)}, '')), ''), lambda x: x <> '')"


@query(f"SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) AS INT) AS index FROM (SELECT token, count(*) n FROM (SELECT unnest({_CH}) token FROM documents) GROUP BY 1)")
def char_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return mlprep.vocabulary(read(spark, d, "documents"), mlprep.characters(F.col("text")))


@query("""SELECT item_id, CAST(i + 1 AS INT) AS "at", text[i + 1:i + 40] AS "window", text[i + 41:i + 41] AS "next" FROM (SELECT item_id, text, unnest(range(0, length(text) - 40, 3)) i FROM eval_item WHERE length(text) > 40)""")
def ngram_windows(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "eval_item").select("item_id", F.explode(mlprep.ngram_windows(F.col("text"))).alias("w")).select("item_id", "w.*")


_SIM = "(1 - d / greatest(length(a), length(b)) > 0.66 OR starts_with(upper(a), upper(b)) OR starts_with(upper(b), upper(a)))"
_METRICS = "round(CASE WHEN {1} > 0 THEN {0} / {1} END, 6) AS \"{2}\""


@query(f"""WITH {_TITLES}, c AS (SELECT count(*) FILTER (y AND z) tp, count(*) FILTER (NOT y AND z) fp, count(*) FILTER (NOT y AND NOT z) tn, count(*) FILTER (y AND NOT z) fn FROM (SELECT d < greatest(1, m / 8) y, {_SIM} z FROM p WHERE d < greatest(1, m / 4)))
SELECT tp, fp, tn, fn, {_METRICS.format('(tp + tn)', '(tp + fp + tn + fn)', 'accuracy')}, {_METRICS.format('tp', '(tp + fp)', 'precision')}, {_METRICS.format('tp', '(tp + fn)', 'recall')}, {_METRICS.format('(2 * tp)', '(2 * tp + fp + fn)', 'f1')}, {_METRICS.format('(2 * tn)', '(2 * tn + fp + fn)', 'f1_negative')} FROM c""")
def baseline_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The baseline matcher against the strictest tier, over all near titles."""
    near = match.similar_texts(*_titles(spark, d))
    truth = F.levenshtein("a", "b") < F.greatest(F.lit(1.0), F.least(F.length("a"), F.length("b")) / 8.0)
    return mlprep.metrics(near, truth, match.baseline_same(F.col("a"), F.col("b")))


_CHT = f"list_filter(string_split(lower(translate(titre, {q.quote(mlprep.FILTERED)}, '')), ''), lambda x: x <> '')"


@query(f"""WITH l AS (SELECT id_livre, {_CHT} l FROM livre WHERE titre IS NOT NULL), e AS (SELECT id_livre, unnest(l) token, generate_subscripts(l, 1) pos FROM l),
v AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) i FROM e GROUP BY 1), s AS (SELECT id_livre, list(i ORDER BY pos) x FROM e JOIN v USING (token) GROUP BY 1)
SELECT id_livre, array_to_string(list_concat(list_transform(range(0, greatest(150 - coalesce(len(x), 0), 0)), lambda k: 0), coalesce(x[greatest(len(x) - 149, 1):], [])), ' ') features FROM l LEFT JOIN s USING (id_livre)""")
def char_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Character indexes of titles, padded to 150 places."""
    notices = read(spark, d, "livre").where("titre is not null")
    vocab = mlprep.vocabulary(notices, mlprep.characters(F.col("titre")))
    return mlprep.sequences(notices, "id_livre", mlprep.characters(F.col("titre")), vocab).select("id_livre", F.array_join("features", " ").alias("features"))


@query()
def title_model(spark: SparkSession, d: str) -> DataFrame:
    """A logistic model fitted on at most 1,000 balanced couples, tested on all other couples: its metrics."""
    near = match.similar_texts(*_titles(spark, d)).withColumn("d", F.levenshtein("a", "b"))
    couples = cut(near.where((F.col("d") <= 1) | (F.col("d") > 3)).select("a", "b", (F.col("d") <= 1).cast("int").alias("label")))
    train, test = mlprep.train_and_rest(couples, 500, ["a", "b"])
    done = mlprep.title_classifier(mlprep.pair_features(train, "a", "b")).transform(mlprep.pair_features(test, "a", "b"))
    return mlprep.metrics(done, F.col("label") == 1, F.col("prediction") == 1.0)


from catalink.plans import interchange, records  # noqa: E402, F401 - they add their queries
