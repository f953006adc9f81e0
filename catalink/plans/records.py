"""Queries on source records: mappers, filters, tiers, profiles of sources, graphs and learning tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalink.functions import text
from catalink.operators import graph, match, mlprep, profile
from catalink.plans import sqltext as q
from catalink.plans.registry import query
from catalink.runtime import read

# --- mappers --------------------------------------------------------------------------------------------------


def _shown(books: DataFrame) -> DataFrame:
    return books.select("id", "data_base", "title", F.array_join("authors", "|").alias("authors"), F.array_join("isbns", "|").alias("isbns"))


def _sql_book(table: str, key: str, source: str, title: str, authors: str, isbns: str) -> str:
    return f"""SELECT CAST({key} AS VARCHAR) id, '{source}' data_base, {q.normal(title)} title,
  array_to_string(list_filter(list_transform({authors}, lambda x: {q.author('x')}), lambda x: x <> ''), '|') authors,
  array_to_string(list_filter(list_transform({isbns}, lambda x: {q.isbn('x')}), lambda x: x <> ''), '|') isbns FROM {table}"""


def _parts(column: str, pattern: str) -> str:
    return f"list_filter(list_transform(string_split_regex(coalesce({column}, ''), '{pattern}'), lambda x: trim(x)), lambda x: x <> '')"


@query(_sql_book("depotlegal20171231", "no_ligne", "depot", "split_part(split_part(titre_publication, ' / ', 1), ' : ', 1)", f"list_transform({_parts('liste_auteur', ';')}, lambda x: {q.swapped('x')})", _parts("liste_isbn_nettoye", "[|;,]")))
def books_deposit(spark: SparkSession, d: str) -> DataFrame:
    """Book records of the legal-deposit file."""
    return _shown(match.deposit_books(read(spark, d, "depotlegal20171231")))


_ROLE = "coalesce(" + ", ".join(f"nullif(strpos(x, {q.quote(r)}), 0)" for r, _ in text.ROLES) + ")"


@query(_sql_book("exportation_hurtubise", "no_ligne", "hurtubise", "titre", f"list_filter(list_transform({_parts('contributeurs', ',')}, lambda x: coalesce(left(x, greatest({_ROLE} - 2, 0)), '')), lambda x: x <> '')", "list_filter([isbn_papier, isbn_pdf, isbn_epub], lambda x: coalesce(x, '') <> '')"))
def books_export(spark: SparkSession, d: str) -> DataFrame:
    """Book records of a publisher's export."""
    return _shown(match.export_books(read(spark, d, "exportation_hurtubise")))


@query(_sql_book("babelio_book", "rec_id", "babelio", "title", f"list_transform(coalesce(author, []), lambda x: {q.swapped('x')})", "CASE WHEN ean IS NULL THEN [] ELSE [ean] END"))
def books_pages(spark: SparkSession, d: str) -> DataFrame:
    """Book records of crawled pages."""
    return _shown(match.page_books(read(spark, d, "babelio_book")))


_AUTHORS_OF = "(SELECT id_livre i, list_sort(list_distinct(list_filter(coalesce(auteurs, []), lambda x: x IS NOT NULL))) a FROM livre) k"


@query(_sql_book(f"livre JOIN {_AUTHORS_OF} ON id_livre = k.i WHERE source = 'ile'", "id_livre", "ile", "titre", f"list_transform(k.a, lambda x: {q.swapped('x')})", _parts("array_to_string(isbn, ',')", "[|;,]")))
def books_ile(spark: SparkSession, d: str) -> DataFrame:
    """Book records of works and authors in two tables, joined by the author's address."""
    r = read(spark, d, "livre").where("source = 'ile'")
    works = r.select(F.col("id_livre").alias("id"), F.col("titre").alias("title"), F.array_join("isbn", ",").alias("isbn"), F.explode_outer("auteurs").alias("nom")).withColumn("author_uri", F.concat(F.lit("ile/"), "nom"))
    return _shown(match.ile_books(works.drop("nom"), works.select(F.col("author_uri").alias("uri"), "nom").where("uri is not null").distinct()))


_NS = "https://schema.org/"


def _graph(spark: SparkSession, d: str, source: str) -> DataFrame:
    r = read(spark, d, "livre").where(F.col("source") == source)
    properties = [(graph.RDF_TYPE, F.lit(_NS + "Book"), "uri", None, None), (_NS + "name", F.col("titre"), "literal", None, "fr"), (_NS + "isbn", F.col("isbn"), "literal", None, None), (_NS + "author", F.col("auteurs"), "literal", None, None), (_NS + "datePublished", F.col("annee"), "literal", None, None), (_NS + "edition", F.col("editeur"), "literal", None, None)]
    return graph.emit(r, F.concat(F.lit("livre/"), F.col("id_livre").cast("string")), properties)


_SET = "list_sort(list_distinct(list_filter(coalesce({}, []), lambda x: x <> '')))"


@query(_sql_book("livre WHERE source = 'adp'", "'livre/' || id_livre", "adp", "nullif(titre, '')", _SET.format("auteurs"), _SET.format("isbn")))
def books_graph(spark: SparkSession, d: str) -> DataFrame:
    """Book records out of a graph."""
    return _shown(match.graph_books(_graph(spark, d, "adp"), "adp", _NS + "name", _NS + "author", _NS + "isbn"))


@query("SELECT rec_id, r.id id, r.rating note, r.content texte FROM (SELECT rec_id, unnest(reviews) r FROM babelio_book)")
def renamed_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields renamed by a dictionary, also within lists of records."""
    r = text.renamed(read(spark, d, "babelio_book"), {"reviews": "critiques", "rating": "note", "content": "texte"})
    return r.select("rec_id", F.explode("critiques").alias("c")).select("rec_id", "c.id", "c.note", "c.texte")


@query("SELECT rec_id, r.id id, replace(regexp_replace(r.content, '\t+', ' ', 'g'), chr(10), '') content FROM (SELECT rec_id, unnest(reviews) r FROM babelio_book)")
def cleaned_items(spark: SparkSession, d: str) -> DataFrame:
    """Reviews without tabs and line ends, cleaned wherever they lie in an item."""
    return text.clean_items(read(spark, d, "babelio_book").select("rec_id", "reviews")).select("rec_id", F.explode("reviews").alias("r")).select("rec_id", "r.id", "r.content")


@query("""SELECT kind, count(*) n, count(title) titles, count(name) AS names FROM (SELECT CASE WHEN author_id IS NULL THEN 'author or unknown' ELSE 'book' END kind, title, NULL AS name FROM babelio_book
UNION ALL SELECT 'author or unknown', NULL, name FROM babelio_author) GROUP BY 1""")
def routed_items(spark: SparkSession, d: str) -> DataFrame:
    """Two crawls in one stream, columns that one lacks being null, parted by whether an item names its author."""
    both = read(spark, d, "babelio_book").select("rec_id", "title", "author_id").unionByName(read(spark, d, "babelio_author").select("author_key", "name"), allowMissingColumns=True)
    kind = F.when(F.col("author_id").isNull(), "author or unknown").otherwise("book")
    return both.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count("title").alias("titles"), F.count("name").alias("names"))


@query("SELECT DISTINCT n FROM (SELECT name n FROM babelio_author UNION ALL SELECT author_db.name FROM couple_writers UNION ALL SELECT author_wiki.name FROM couple_writers) WHERE n IS NOT NULL")
def all_names(spark: SparkSession, d: str) -> DataFrame:
    """The union of the names of all sources, each once."""
    c = read(spark, d, "couple_writers")
    return read(spark, d, "babelio_author").select(F.col("name").alias("n")).union(c.select("author_db.name")).union(c.select("author_wiki.name")).where("n is not null").distinct()


# --- filters --------------------------------------------------------------------------------------------------


@query("SELECT id_livre, editeur FROM livre WHERE editeur IN (SELECT nom_editeur FROM depotlegal20171231)")
def listed_publishers(spark: SparkSession, d: str) -> DataFrame:
    """Notices of publishers on a list."""
    known = read(spark, d, "depotlegal20171231").select(F.col("nom_editeur").alias("editeur")).distinct()
    return read(spark, d, "livre").join(known, "editeur", "left_semi").select("id_livre", "editeur")


@query("SELECT no_ligne, titre FROM exportation_hurtubise WHERE starts_with(editeur, 'Éditions')")
def prefixed_lines(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "exportation_hurtubise").where(F.col("editeur").startswith("Éditions")).select("no_ligne", "titre")


_T = f"""t AS (SELECT DISTINCT s, p, o FROM (
  SELECT 'livre/' || id_livre s, '{graph.RDF_TYPE}' p, '{_NS}Book' o, source FROM livre UNION ALL SELECT 'livre/' || id_livre, '{_NS}name', titre, source FROM livre
  UNION ALL SELECT 'livre/' || id_livre, '{_NS}isbn', unnest(isbn), source FROM livre UNION ALL SELECT 'livre/' || id_livre, '{_NS}author', unnest(auteurs), source FROM livre
  UNION ALL SELECT 'livre/' || id_livre, '{_NS}datePublished', annee, source FROM livre UNION ALL SELECT 'livre/' || id_livre, '{_NS}edition', editeur, source FROM livre) WHERE o <> '' AND source = '{{}}')"""


@query(f"WITH {_T.format('ile')} SELECT p, count(*) n FROM t WHERE NOT contains(p, 'edition') GROUP BY 1")
def other_properties(spark: SparkSession, d: str) -> DataFrame:
    """Counts of all properties but those of a name."""
    return _graph(spark, d, "ile").where(~F.col("p").contains("edition")).groupBy("p").agg(F.count("*").alias("n"))


@query(f"WITH {_T.format('ile')} SELECT DISTINCT s, o FROM t WHERE p IN ('{_NS}author', '{_NS}edition')")
def either_property(spark: SparkSession, d: str) -> DataFrame:
    """Subjects and what one of two properties says."""
    return _graph(spark, d, "ile").where(F.col("p").isin(_NS + "author", _NS + "edition")).select("s", "o").distinct()


@query(f"WITH {_T.format('hurtubise')} SELECT a.s, a.o label, b.o other FROM t a LEFT JOIN t b ON a.s = b.s AND b.p = '{_NS}datePublished' WHERE a.p = '{_NS}name'")
def french_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels in French, with an optional property."""
    t = _graph(spark, d, "hurtubise")
    other = t.where(F.col("p") == _NS + "datePublished").select("s", F.col("o").alias("other"))
    return t.where((F.col("p") == _NS + "name") & F.col("o_lang").isin("fr", "en")).select("s", F.col("o").alias("label")).join(other, "s", "left")


@query("SELECT 'isbn' field, t AS over, count(*) n, min(id_livre) first FROM (SELECT id_livre, coalesce(len(isbn), 0) k, unnest([1, 2, 3]) t FROM livre) WHERE k > t GROUP BY 2 UNION ALL SELECT 'auteurs', t, count(*), min(id_livre) FROM (SELECT id_livre, coalesce(len(auteurs), 0) k, unnest([1, 2, 3]) t FROM livre) WHERE k > t GROUP BY 2")
def more_than(spark: SparkSession, d: str) -> DataFrame:
    """How many notices have more than 1, 2 or 3 ISBNs or authors, with the first of them."""
    r = read(spark, d, "livre")
    return profile.more_than(r, "isbn", (1, 2, 3), "id_livre").union(profile.more_than(r, "auteurs", (1, 2, 3), "id_livre"))


# --- joins ----------------------------------------------------------------------------------------------------


@query("SELECT auteur_key, nullif(trim(concat_ws(' ', nullif(prenom, ''), nullif(nom, ''))), '') AS name FROM auteur")
def author_names(spark: SparkSession, d: str) -> DataFrame:
    """Full names by two optional joins: given and family name, or the one there is."""
    r = read(spark, d, "auteur")
    t = graph.emit(r, F.col("auteur_key"), [("given", F.col("prenom"), "literal", None, None), ("family", F.col("nom"), "literal", None, None), (graph.RDF_TYPE, F.lit("Person"), "uri", None, None)])
    s = graph.star(t, {}, {"given": "given", "family": "family"}, cls="Person")
    return s.select(F.col("s").alias("auteur_key"), graph.full_name(F.col("given"), F.col("family")).alias("name"))


def _near(a: str, b: str, tiers: tuple[int, ...]) -> str:
    """SQL of tiers over two lists of distinct texts."""
    case, last = "", None
    for k in tiers:
        case += f" WHEN d < greatest(1, m / {k}){f' AND d > greatest(1, m / {last})' if last else ''} THEN {k}"
        last = k
    return f"""WITH a AS MATERIALIZED ({a}), b AS MATERIALIZED ({b}), {q.odd_signs('SELECT a t FROM a UNION SELECT b FROM b')},
xa AS MATERIALIZED (SELECT a, {q.one_byte('a')} x FROM a), xb AS MATERIALIZED (SELECT b, {q.one_byte('b')} y FROM b),
p AS (SELECT a, b, levenshtein(x, y) d, least(length(a), length(b)) m FROM xa, xb WHERE abs(length(a) - length(b)) <= 1 + length(a) / 3)
SELECT * FROM (SELECT a, b, d, CASE{case} END tier FROM p) WHERE tier IS NOT NULL"""


_NOTICE_NAME = q.author("trim(coalesce(prenom, '') || ' ' || coalesce(nom, ''))")


@query(_near(f"SELECT DISTINCT {_NOTICE_NAME} a FROM auteur", f"SELECT DISTINCT {q.author(q.swapped('name'))} b FROM babelio_author WHERE name IS NOT NULL", (8, 6)))
def author_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Names of author notices and author pages by two tiers of similarity."""
    a = read(spark, d, "auteur").select(text.normalize_author(F.trim(F.concat(F.coalesce("prenom", F.lit("")), F.lit(" "), F.coalesce("nom", F.lit(""))))).alias("a")).distinct()
    b = read(spark, d, "babelio_author").where("name is not null").select(text.normalize_author(text.swap_name(F.col("name"))).alias("b")).distinct()
    return match.tiered(a, b, (8, 6))


@query(_near(f"SELECT DISTINCT {q.author('author_db.name')} a FROM couple_writers WHERE author_db.name IS NOT NULL", f"SELECT DISTINCT {q.author('name')} b FROM babelio_author WHERE name IS NOT NULL", (8, 6, 4)))
def wiki_author_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue authors and names of pages by three tiers of similarity."""
    a = read(spark, d, "couple_writers").where("author_db.name is not null").select(text.normalize_author(F.col("author_db.name")).alias("a")).distinct()
    b = read(spark, d, "babelio_author").where("name is not null").select(text.normalize_author(F.col("name")).alias("b")).distinct()
    return match.tiered(a, b, (8, 6, 4))


@query("SELECT count(*) n FROM (SELECT author_db.name AS name FROM couple_writers WHERE nb_books > 1) a JOIN (SELECT author_db.name AS name FROM couple_writers WHERE nb_books <= 1) b USING (name)")
def couples_by_name(spark: SparkSession, d: str) -> DataFrame:
    """How many couples of two lists share a catalogue author's name."""
    c = read(spark, d, "couple_writers").select("nb_books", F.col("author_db.name").alias("name"))
    return match.couples_by_name(c.where("nb_books > 1"), c.where("nb_books <= 1"))


@query("""WITH n AS (SELECT DISTINCT author_wiki.name AS name FROM couple_writers WHERE author_wiki.name IS NOT NULL), l AS (SELECT author_key s, name AS name, bibliography FROM babelio_author UNION SELECT author_key, replace(regexp_extract(url, '^/auteur/([^/]+)', 1), '-', ' '), bibliography FROM babelio_author),
h AS (SELECT DISTINCT name, s FROM n JOIN l USING (name) WHERE len(bibliography) > 0)
SELECT n.name, count(s) hits, CASE WHEN count(s) = 1 THEN max(s) END s FROM n LEFT JOIN h USING (name) GROUP BY 1""")
def labels_found(spark: SparkSession, d: str) -> DataFrame:
    """Names looked up among labels and other labels of authors with works; accepted where the hit is the only one."""
    a = read(spark, d, "babelio_author")
    labels = a.select(F.col("author_key").alias("s"), F.col("name").alias("label")).union(a.select("author_key", F.replace(F.regexp_extract("url", "^/auteur/([^/]+)", 1), F.lit("-"), F.lit(" "))))
    names = read(spark, d, "couple_writers").select(F.col("author_wiki.name").alias("name")).where("name is not null")
    return graph.labelled(names, labels, a.where(F.size("bibliography") > 0).select(F.col("author_key").alias("s")))


@query("SELECT author_db.author_key k, CAST(count(DISTINCT author_wiki.author_key) AS BIGINT) wikis, coalesce(array_to_string(list_sort(list(DISTINCT author_wiki.name) FILTER (author_wiki.name IS NOT NULL)), ';'), '') AS names FROM couple_writers WHERE author_db.author_key IS NOT NULL GROUP BY 1")
def folded_records(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an answer folded into one record per author, with the set of names it was met under."""
    c = read(spark, d, "couple_writers").where("author_db.author_key is not null")
    return c.groupBy(F.col("author_db.author_key").alias("k")).agg(F.count_distinct("author_wiki.author_key").alias("wikis"), F.array_join(F.array_sort(F.collect_set("author_wiki.name")), ";").alias("names"))


@query("""SELECT count(*) authors, count(*) FILTER (len(awards) > 0) with_awards, CAST(sum(coalesce(len(awards), 0)) AS BIGINT) awards, CAST(sum(coalesce(len(bibliography), 0)) AS BIGINT) works, (SELECT count(DISTINCT a) FROM (SELECT unnest(awards) a FROM babelio_author)) names FROM babelio_author""")
def award_totals(spark: SparkSession, d: str) -> DataFrame:
    """Awards and works of all authors, and how many different awards there are."""
    a = read(spark, d, "babelio_author")
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    names = a.select(F.explode("awards").alias("a")).agg(F.count_distinct("a").alias("names")).first()[0]
    return a.agg(F.count("*").alias("authors"), F.count_if(size("awards") > 0).alias("with_awards"), F.coalesce(F.sum(size("awards")), F.lit(0)).cast("long").alias("awards"), F.coalesce(F.sum(size("bibliography")), F.lit(0)).cast("long").alias("works")).withColumn("names", F.lit(names).cast("long"))


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT 'k' || c_nationkey a, 'c' || c_custkey b FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)),
b AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
cc(v, g) USING KEY (v) AS (SELECT DISTINCT a, a FROM b UNION SELECT b.b, min(cc.g) FROM cc JOIN b ON b.a = cc.v JOIN recurring.cc u ON u.v = b.b WHERE cc.g < u.g GROUP BY b.b)
SELECT v AS key, g AS "group" FROM cc""")
def connected_groups(spark: SparkSession, d: str) -> DataFrame:
    """Everything linked directly or through others, by the smallest key."""
    e = read(spark, d, "customer").select(F.concat(F.lit("k"), "c_nationkey").alias("a"), F.concat(F.lit("c"), "c_custkey").alias("b")).union(read(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("o"), "o_orderkey")))
    return graph.connected(e, "a", "b")


# --- profiles -------------------------------------------------------------------------------------------------


@query(f"""WITH {_T.format('ile')} SELECT p, CASE WHEN p = '{_NS}edition' THEN split_part(o, ',', 1) ELSE o END AS value, count(*) n FROM t WHERE o <> '{_NS}Book' GROUP BY 1, 2""")
def ile_profile(spark: SparkSession, d: str) -> DataFrame:
    """Values of a source's graph; an edition counts by what stands before its first comma."""
    t = _graph(spark, d, "ile")
    value = F.when(F.col("p") == _NS + "edition", F.split_part("o", F.lit(","), F.lit(1))).otherwise(F.col("o"))
    return t.where(F.col("o") != _NS + "Book").groupBy("p", value.alias("value")).agg(F.count("*").alias("n"))


@query("SELECT nom_editeur publisher, count(DISTINCT no_ligne) n FROM depotlegal20171231 JOIN (SELECT DISTINCT code_editeur c FROM depotlegal20171231) ON code_editeur = c WHERE nom_editeur <> '' GROUP BY 1")
def publisher_profile(spark: SparkSession, d: str) -> DataFrame:
    """Books of a graph by their publishers' names, resolved by one hop."""
    r = read(spark, d, "depotlegal20171231").where("code_editeur is not null")
    node = F.concat_ws("/", F.lit("pub"), "code_editeur", "nom_editeur")
    t = graph.emit(r, F.col("no_ligne").cast("string"), [("publisher", node, "uri", None, None)]).unionByName(graph.emit(r, node, [("name", F.col("nom_editeur"), "literal", None, None)]))
    return graph.hop(t, "publisher", "name").groupBy(F.col("label").alias("publisher")).agg(F.count_distinct("s").alias("n"))


@query("SELECT coalesce(prenom, '') || ' ' || coalesce(nom, '') AS name, count(*) n FROM auteur GROUP BY 1")
def deposit_author_profile(spark: SparkSession, d: str) -> DataFrame:
    """Authors by given name, blank and family name, which may be the blank alone."""
    return read(spark, d, "auteur").groupBy(F.concat(F.coalesce("prenom", F.lit("")), F.lit(" "), F.coalesce("nom", F.lit(""))).alias("name")).agg(F.count("*").alias("n"))


@query(f"""WITH k AS (SELECT w AS word, count(*) n FROM (SELECT unnest({_parts('mots_cles', ',')}) w FROM exportation_hurtubise) GROUP BY 1)
SELECT word, n, CAST(row_number() OVER (ORDER BY n DESC, word DESC) AS INT) place FROM k""")
def keyword_counts(spark: SparkSession, d: str) -> DataFrame:
    """Keywords by falling number, equal ones by falling word."""
    each = read(spark, d, "exportation_hurtubise").select(F.explode(text.split_list(F.col("mots_cles"), ",")).alias("word"))
    return mlprep.numbered(each.groupBy("word").agg(F.count("*").alias("n")), [F.desc("n"), F.desc("word")], "place").withColumn("place", F.col("place").cast("int"))


@query("""SELECT coalesce(annee, '') <> '' AS edition, coalesce(len(isbn), 0) > 0 AS isbn, count(*) n, count(*) FILTER (contains(array_to_string(isbn, ' '), '-')) hyphens FROM livre GROUP BY 1, 2""")
def edition_isbn_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Notices with and without a year and an ISBN, and how many write it with hyphens."""
    r = read(spark, d, "livre")
    return r.groupBy((F.coalesce("annee", F.lit("")) != "").alias("edition"), (F.coalesce(F.when(F.col("isbn").isNotNull(), F.size("isbn")), F.lit(0)) > 0).alias("isbn")).agg(F.count("*").alias("n"), F.count_if(F.array_join("isbn", " ").contains("-")).alias("hyphens"))


@query("SELECT titles, count(*) n FROM (SELECT i, count(DISTINCT titre) titles FROM (SELECT unnest(isbn) i, titre FROM livre) GROUP BY 1) GROUP BY 1")
def titles_per_isbn(spark: SparkSession, d: str) -> DataFrame:
    """How many ISBNs have so many different titles."""
    each = read(spark, d, "livre").select(F.explode("isbn").alias("i"), "titre").distinct()
    return each.groupBy("i").agg(F.count("titre").alias("titles")).groupBy("titles").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT DISTINCT author_db.name AS name FROM couple_writers), b AS (SELECT source, unnest(auteurs) a FROM livre), s AS (SELECT source, count(*) links, count(*) FILTER (a IN (SELECT name FROM m)) matched FROM b GROUP BY 1)
SELECT source, links, matched, round(100.0 * matched / links, 6) "share" FROM s""")
def match_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Of each source's author links, how many and what percentage name a matched author."""
    m = read(spark, d, "couple_writers").select(F.col("author_db.name").alias("a")).where("a is not null").distinct().withColumn("hit", F.lit(1))
    b = read(spark, d, "livre").select("source", F.explode("auteurs").alias("a")).join(m, "a", "left")
    return b.groupBy("source").agg(F.count("*").alias("links"), F.count("hit").alias("matched")).withColumn("share", F.round(F.lit(100.0) * F.col("matched") / F.col("links"), 6))


@query("SELECT k, n FROM (SELECT author_db.author_key k, count(*) n FROM couple_writers WHERE author_db.author_key IS NOT NULL GROUP BY 1) ORDER BY n DESC, k LIMIT 10")
def most_matched(spark: SparkSession, d: str) -> DataFrame:
    """The ten authors with most couples."""
    c = read(spark, d, "couple_writers").select(F.col("author_db.author_key").alias("k")).where("k is not null")
    return c.groupBy("k").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(10)


@query("SELECT count(DISTINCT nom) AS names, count(*) persons, count(*) FILTER (coalesce(annee_naissance, '') <> '') dated FROM auteur")
def names_and_persons(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "auteur").agg(F.count_distinct("nom").alias("names"), F.count("*").alias("persons"), F.count_if(F.coalesce("annee_naissance", F.lit("")) != "").alias("dated"))


@query("SELECT CAST((row_number() OVER (ORDER BY id_livre) - 1) % 7 AS BIGINT) stride, id_livre FROM livre")
def strides(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh record in one part, counted in order of the ids."""
    r = mlprep.numbered(read(spark, d, "livre").select("id_livre"), [F.col("id_livre")], "i", first=0)
    return r.select((F.col("i") % 7).alias("stride"), "id_livre")


_TITLE_PAIRS = f"""a AS MATERIALIZED (SELECT DISTINCT {q.normal('title')} a FROM babelio_book WHERE title IS NOT NULL), b AS MATERIALIZED (SELECT DISTINCT {q.normal('titre')} b, titre raw FROM livre WHERE titre IS NOT NULL),
{q.odd_signs('SELECT a t FROM a UNION SELECT b FROM b')}, xa AS MATERIALIZED (SELECT a, {q.one_byte('a')} x FROM a), xb AS MATERIALIZED (SELECT b, raw, {q.one_byte('b')} y FROM b),
p AS MATERIALIZED (SELECT a, b, raw, levenshtein(x, y) d, least(length(a), length(b)) m, least(length(a), length(raw)) w FROM xa, xb WHERE abs(length(a) - length(b)) <= 1 + length(a) / 3)"""


def _titles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = read(spark, d, "babelio_book").where("title is not null").select(text.normalize(F.col("title")).alias("a")).distinct()
    b = read(spark, d, "livre").where("titre is not null").select(text.normalize(F.col("titre")).alias("b"), F.col("titre").alias("raw")).distinct()
    return a, b


@query(f"""WITH {_TITLE_PAIRS} SELECT * FROM (SELECT a, b, raw, d, CASE WHEN d < greatest(1, w / 8) THEN 8 WHEN d < greatest(1, w / 6) AND d > greatest(1, w / 8) THEN 6 WHEN d < greatest(1, m / 4) AND d > greatest(1, m / 6) THEN 4 END tier FROM p) WHERE tier IS NOT NULL""")
def written_title_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Tiers of similarity whose stricter bounds take the length of a title as it is written."""
    return match.tiered_raw(*_titles(spark, d))


_TCH = f"list_filter(string_split(lower(translate({{}}, {q.quote(mlprep.FILTERED)}, '')), ''), lambda x: x <> '')"
_CODE = "array_to_string(list_concat(list_transform(range(0, greatest(150 - coalesce(len({0}), 0), 0)), lambda k: 0), coalesce({0}[greatest(len({0}) - 149, 1):], [])), ' ')"


@query(f"""WITH {_TITLE_PAIRS}, z AS (SELECT DISTINCT a, b FROM p WHERE d BETWEEN 1 AND 2 AND d < greatest(1, m / 4)), t AS (SELECT a t FROM z UNION SELECT b FROM z), l AS (SELECT t, {_TCH.replace('{}', 't')} l FROM t), e AS (SELECT t, unnest(l) token, generate_subscripts(l, 1) pos FROM l),
v AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) i FROM e GROUP BY 1), s AS (SELECT t, list(i ORDER BY pos) x FROM e JOIN v USING (token) GROUP BY 1)
SELECT a, b, {_CODE.format('k.x')} || ' ' || {_CODE.format('n.x')} features FROM z LEFT JOIN s k ON k.t = a LEFT JOIN s n ON n.t = b""")
def title_pair_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Near titles as two padded sequences of character indexes, one behind the other."""
    a, b = _titles(spark, d)
    near = match.similar_texts(a, b.select("b").distinct()).where(F.levenshtein("a", "b").between(1, 2))
    texts = near.select(F.col("a").alias("t")).union(near.select("b")).distinct()
    vocab = mlprep.vocabulary(texts, mlprep.characters(F.col("t")))
    return mlprep.pair_sequences(near, "a", "b", vocab).select("a", "b", F.array_join("features", " ").alias("features"))


# --- texts ----------------------------------------------------------------------------------------------------

_LOW = "(left({0}, 1) || lower(substr({0}, 2)))"
_CASED = f"""array_to_string(list_transform(list_filter(string_split_regex(trim(name), '\\s+'), lambda w: w <> ''), lambda w: CASE WHEN contains(w, '-') THEN array_to_string(list_transform(string_split(w, '-'), lambda v: {_LOW.format('v')}), '-')
  WHEN contains(w, '''') THEN array_to_string(list_transform(string_split(w, ''''), lambda v: {_LOW.format('v')}), '''') ELSE {_LOW.format('w')} END), ' ')"""


@query(f"SELECT author_key, trim(split_part(name, ',', 1)) family, trim(split_part(name, ',', 2)) given, split_part(name, ' (', 1) bare, concat_ws(' ', name, nullif(regexp_extract(date_of_birth, '(\\d{{4}})$', 1), '')) dated, {_CASED} cased FROM babelio_author")
def name_parts(spark: SparkSession, d: str) -> DataFrame:
    """Family and given name, name without qualifier, with birth year, and in title case."""
    n = F.col("name")
    return read(spark, d, "babelio_author").select("author_key", text.family_name(n).alias("family"), F.when(n.isNotNull(), text.given_name(n)).alias("given"), text.before_paren(n).alias("bare"), text.with_birth_year(n, F.nullif(F.regexp_extract("date_of_birth", r"(\d{4})$", 1), F.lit(""))).alias("dated"), text.title_case(n).alias("cased"))


@query("SELECT auteur_key, CASE WHEN contains(nom, ', ') THEN trim(string_split(nom, ', ')[2]) || ' ' || trim(string_split(nom, ', ')[1]) ELSE trim(nom) END swapped FROM auteur")
def name_swaps(spark: SparkSession, d: str) -> DataFrame:
    """Names turned at a comma and a blank."""
    return read(spark, d, "auteur").select("auteur_key", text.swap_name(F.col("nom"), ", ").alias("swapped"))


@query("SELECT id_livre, concat_ws('/', left(i, 4), substr(i, 5, 3), substr(i, 8, 3), substr(i, 11)) AS path FROM (SELECT id_livre, unnest(isbn) i FROM livre)")
def isbn_paths(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "livre").select("id_livre", F.explode("isbn").alias("i")).select("id_livre", text.isbn_path(F.col("i")).alias("path"))


@query("SELECT id_livre, format('{} book {} [{}]: {} authors, {} isbns', CASE WHEN coalesce(titre, '') <> '' OR id_livre IS NOT NULL THEN 'valid' ELSE 'invalid' END, coalesce(titre, ''), coalesce(source, ''), coalesce(len(auteurs), 0), coalesce(len(isbn), 0)) line FROM livre")
def record_lines(spark: SparkSession, d: str) -> DataFrame:
    """A readable line of each record."""
    none = F.array().cast("array<string>")
    return read(spark, d, "livre").select("id_livre", text.show_record(title=F.col("titre"), id=F.col("id_livre").cast("string"), data_base=F.col("source"), authors=F.coalesce("auteurs", none), isbns=F.coalesce("isbn", none)).alias("line"))


@query("""SELECT no_ligne, titre title, nullif(annee_de_parution, '') "year", 'Montréal' place, trim(editeur) publisher, coalesce(isbn_papier, '') isbn FROM exportation_hurtubise WHERE regexp_full_match(coalesce(annee_de_parution, ''), '\\d{4}') AND titre IS NOT NULL AND NOT contains(titre, '(')
 AND editeur IS NOT NULL AND NOT contains(editeur, ':')""")
def work_notices(spark: SparkSession, d: str) -> DataFrame:
    """Fields of works out of the lines of their notices."""
    r = read(spark, d, "exportation_hurtubise").where(F.coalesce("annee_de_parution", F.lit("")).rlike(r"^\d{4}$") & F.col("titre").isNotNull() & ~F.col("titre").contains("(") & F.col("editeur").isNotNull() & ~F.col("editeur").contains(":"))
    lines = F.array(F.concat(F.col("titre"), F.lit(" ("), "annee_de_parution", F.lit(")")), F.concat(F.lit(", Montréal : "), "editeur"), F.concat(F.lit("ISBN : "), F.coalesce("isbn_papier", F.lit(""))))
    return r.select("no_ligne", *[F.coalesce(c, F.lit("")).alias(n) if n == "isbn" else c.alias(n) for n, c in text.work_info(lines).items()])


@query("SELECT author_key, bio, CASE WHEN regexp_full_match(trim(place_of_birth), '\\[.+\\]') THEN trim(place_of_birth)[2:-2] ELSE trim(place_of_birth) END place FROM babelio_author")
def bios_and_places(spark: SparkSession, d: str) -> DataFrame:
    """Bios without their heading, places without brackets."""
    r = read(spark, d, "babelio_author")
    return r.select("author_key", text.bio_text(F.concat(F.lit("Notice biographique\n"), "bio")).alias("bio"), text.bare_place(F.col("place_of_birth")).alias("place"))


@query("SELECT url, regexp_replace(url, '^/auteur/', '', 'g') tail, string_split(url, '/')[-1] AS last FROM babelio_author")
def replaced_labels(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "babelio_author").select("url", text.label_replace(F.col("url"), "^/auteur/", "").alias("tail"), text.last_part(F.col("url"), "/").alias("last"))


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') k, event_type AS type FROM events""")
def merged_properties(spark: SparkSession, d: str) -> DataFrame:
    """Two maps of an event as one."""
    e = read(spark, d, "events")
    m = text.merged(F.from_json("props", "map<string,string>"), F.create_map(F.lit("type"), F.col("event_type")))
    return e.select("event_id", m.alias("m")).select("event_id", F.coalesce(F.try_element_at("m", F.lit("k")), F.lit("")).alias("k"), F.try_element_at("m", F.lit("type")).alias("type"))


@query("SELECT rec_id, concat_ws('|', coalesce(title, ''), coalesce(editor, ''), coalesce(edition_date, ''), coalesce(nb_pages, '')) card FROM babelio_book")
def coded_cards(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a page as one text with separators."""
    return read(spark, d, "babelio_book").select("rec_id", mlprep.coded_fields({c: F.col(c) for c in ("title", "editor", "edition_date", "nb_pages")}).alias("card"))


# --- learning -------------------------------------------------------------------------------------------------

_WORDS = f"list_filter(string_split(lower(translate(text, {q.quote(mlprep.FILTERED)}, repeat(' ', {len(mlprep.FILTERED)}))), ' '), lambda x: x <> '')"


@query(f"SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) AS INT) AS index FROM (SELECT token, count(*) n FROM (SELECT unnest({_WORDS}) token FROM eval_item) GROUP BY 1)")
def word_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Words by falling frequency."""
    return mlprep.vocabulary(read(spark, d, "eval_item"), mlprep.words(F.col("text")))


@query("SELECT token, row_number() OVER (ORDER BY token) - 1 AS index FROM (SELECT DISTINCT unnest(string_split(text, '')) token FROM eval_item) WHERE token <> ''")
def distinct_characters(spark: SparkSession, d: str) -> DataFrame:
    return mlprep.distinct_characters(read(spark, d, "eval_item"), "text")


@query("""WITH c AS (SELECT (nb_books > 1)::INT AS label, count(*) n FROM couple_writers WHERE nb_books IS NOT NULL GROUP BY 1)
SELECT label, s split, CAST(k AS BIGINT) n FROM (SELECT label, unnest(['train', 'test', 'rest']) s, unnest([least(n, 300), greatest(least(n - 300, 50), 0), greatest(n - 350, 0)]) k FROM c) WHERE k > 0""")
def split_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Exactly 300 rows of each label to fit on, 50 others to test on, the rest unused."""
    c = read(spark, d, "couple_writers").where("nb_books is not null").select("couple_id", (F.col("nb_books") > 1).cast("int").alias("label"))
    return mlprep.exact_split(c, 300, 50, ["couple_id"]).groupBy("label", "split").agg(F.count("*").alias("n"))


@query(f"""WITH v AS (SELECT c token, row_number() OVER (ORDER BY c) - 1 AS index FROM (SELECT DISTINCT unnest(string_split(text, '')) c FROM eval_item) WHERE c <> ''),
w AS (SELECT item_id, CAST(i + 1 AS INT) AS "at", text[i + 1:i + 40] AS "window" FROM (SELECT item_id, text, unnest(range(0, length(text) - 40, 120)) i FROM eval_item WHERE length(text) > 40)),
e AS (SELECT item_id, "at", unnest(string_split("window", '')) token, generate_subscripts(string_split("window", ''), 1) - 1 i FROM w)
SELECT item_id, "at", CAST(i AS INT) i, index FROM e JOIN v USING (token)""")
def one_hot_windows(spark: SparkSession, d: str) -> DataFrame:
    """Where the ones stand in the tensors of text windows."""
    r = read(spark, d, "eval_item")
    w = r.select("item_id", F.explode(mlprep.ngram_windows(F.col("text"), 40, 120)).alias("w")).select("item_id", "w.at", "w.window")
    return mlprep.one_hot(w, ["item_id", "at"], "window", mlprep.distinct_characters(r, "text"))


@query("""WITH s AS (SELECT event_type, count(*) / sum(count(*)) OVER () p FROM events GROUP BY 1) SELECT event_type, round(exp(ln(p) / 0.5) / sum(exp(ln(p) / 0.5)) OVER (), 6) p FROM s""")
def tempered_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of kinds of events, sharpened by a temperature."""
    n = read(spark, d, "events").groupBy("event_type").agg(F.count("*").cast("double").alias("n"))
    whole = n.agg(F.sort_array(F.collect_list(F.struct("event_type", "n"))).alias("k"))  # one row per kind of event
    total = F.aggregate("k", F.lit(0.0), lambda a, x: a + x.n)
    sharp = mlprep.tempered(F.transform("k", lambda x: x.n / total), 0.5)
    return whole.select(F.posexplode(sharp).alias("i", "p"), "k").select(F.get("k", F.col("i")).event_type.alias("event_type"), F.round("p", 6).alias("p"))


@query("""SELECT threshold, gated, count(*) n FROM (SELECT unnest([0.1, 0.5]) threshold, g gated, CASE WHEN g THEN levenshtein(a, b) < 1 ELSE true END ok, p FROM (SELECT o_orderpriority a, c_mktsegment b, o_totalprice / 500000 p, unnest([true, false]) g FROM orders JOIN customer ON o_custkey = c_custkey)) WHERE p > threshold AND ok GROUP BY 1, 2""")
def thresholded(spark: SparkSession, d: str) -> DataFrame:
    """Predictions over a threshold, with and without the gate of equal texts."""
    r = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    r = r.select((F.col("o_totalprice") / 500000).alias("p"), F.levenshtein("o_orderpriority", "c_mktsegment").alias("d"))
    each = [r.where(mlprep.predicted(F.col("p"), t, F.col("d") if g else None)).agg(F.count("*").alias("n")).select(F.lit(t).alias("threshold"), F.lit(g).alias("gated"), "n").where("n > 0") for t in (0.1, 0.5) for g in (True, False)]
    return each[0].union(each[1]).union(each[2]).union(each[3])


@query()
def bootstrap_sample(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the events drawn with replacement; the draw is the feature."""
    return mlprep.with_replacement(read(spark, d, "events").select("event_id", "event_type"), 0.1, ["event_id"])


@query()
def principal_components(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings on their two principal components."""
    from pyspark.ml.functions import vector_to_array

    v = mlprep.principal(read(spark, d, "embeddings"), "embedding", 2).select("vec_id", vector_to_array("pca").alias("p"))
    return v.select("vec_id", F.round(F.abs(F.get("p", 0)), 6).alias("first"), F.round(F.abs(F.get("p", 1)), 6).alias("second"))


# --- golden values --------------------------------------------------------------------------------------------

# Function, input and the result worked out by hand.
GOLDEN = (
    ("isbn", "2-89006-591-X", "978289006591X"), ("isbn", "978-2-89006-591-3 (br.)", "9782890065913"), ("isbn", "289006591", "289006591"),
    ("isbn", "289006591X | 2890065912", "289006591X2890065912"), ("isbn", " isbn : 123456789X", "978123456789X"), ("isbn", "978276090000", "978276090000#"),
    ("key", "289006591X", "978289006591X"), ("key", "9872890065913", "987289006591X"), ("key", "987289006591X", "987289006591X"),
    ("key", "2890065912", "978289006591X"), ("key", "292088736X (br.)", "978292088736X"), ("key", "", "X"),
    ("title", "été-là, œuvre!", "ete-la oeuvre"), ("title", "L\u00c3\u00a9gende (((tome) 1) bis) d'hiver", "legende d hiver"), ("title", "\u00c3\u00a7a \u00c3\u00aatre \u00c5\u0093uvre", "ca etre oeuvre"),
    ("author", "a dupont b jean c", "dupontjean"), ("author", "Marie-Ève Roy", "marie-eve roy"), ("swap", "Roy, Marie", "Marie Roy"),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"({q.quote(f)}, {q.quote(i)}, {q.quote(o)})" for f, i, o in GOLDEN) + ") g(kind, said, result)")
def golden_values(spark: SparkSession, d: str) -> DataFrame:
    """Results of the text functions on inputs whose results were worked out by hand."""
    rows = spark.createDataFrame([(f, i) for f, i, _ in GOLDEN], "kind string, said string")
    made = {"isbn": text.normalize_isbn, "key": text.format_isbn, "title": text.normalize, "author": text.normalize_author, "swap": text.swap_name}
    result = F.coalesce(*[F.when(F.col("kind") == n, f(F.col("said"))) for n, f in made.items()])
    return rows.select("kind", "said", result.alias("result"))


# Titles, ISBNs and authors of two records and the case they are.
CASES = (
    ("les belles soeurs", "les belles soeurs", ["9782760900001"], ["978276090000#"], ["a b"], [], "ISBN_TITRE_EQ"),
    ("abcdefgh", "abcdefxy", ["9782760900001"], ["9782760900001"], ["a b"], ["a b"], "ISBN_EQ_TITRE_DIFF"),
    ("abcdefgh", "zzzzzzzz", ["9782760900001"], ["9782760900001"], [], [], "ISBN_EQ_TITRE_T_DIFF"),
    ("le lac", "le lac", ["9782760900001"], ["9782890065913"], [], ["x y"], "ISBN_DIFF_TITRE_EQ"),
    ("la mer", "la mer", ["9782760900001"], ["9782890065913"], ["marie roy"], ["roy marie"], "ISBN_DIFF_TITRE_AUTEUR_EQ"),
    ("la nuit", "la nuit", ["9782760900001"], ["9782890065913"], ["a b"], ["c d"], "PAS_INFO"),
    ("le soir", "le soir", [], ["9782890065913"], ["marie roy"], ["roy m"], "TITRE_AUTEUR_EQ"),
    ("le jour", "le jour", [], [], ["a b"], ["c d"], "TITRE_EQ_AUTEUR_DIFF"),
    ("le vent", "le vent", [], [], [], ["c d"], "TITRE_EQ"),
    ("abcd", "abce", [], [], ["a b"], ["a b"], "PAS_INFO"),
    (None, "le vent", [], [], [], [], "PAS_INFO"),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {q.quote(c[-1])})" for i, c in enumerate(CASES)) + ') g(i, "case")')
def decision_cases(spark: SparkSession, d: str) -> DataFrame:
    """The decision table on records whose case was worked out by hand."""
    rows = spark.createDataFrame([(i, *c[:-1]) for i, c in enumerate(CASES)], "i int, t1 string, t2 string, i1 array<string>, i2 array<string>, a1 array<string>, a2 array<string>")
    return rows.select("i", match.case_of(*[F.col(c) for c in ("t1", "t2", "i1", "i2", "a1", "a2")]).alias("case"))
