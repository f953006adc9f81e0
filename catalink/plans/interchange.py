"""Queries on sources and sinks: tables are written in a format, read back and compared with the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalink.functions import text
from catalink.operators import align, graph, match, mlprep, profile
from catalink.plans import sqltext as q
from catalink.plans.records import _NS, _T, _graph
from catalink.plans.registry import query
from catalink.runtime import read, workspace
from catalink.sources import html, readers, sinks, wiki

# --- delimited and ragged text --------------------------------------------------------------------------------


def _full(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in rows.columns])


@query("SELECT CAST(id_livre AS VARCHAR) id_livre, coalesce(titre, '') titre, coalesce(annee, '') annee, coalesce(array_to_string(auteurs, ';'), '') auteurs FROM livre")
def csv_by_place(spark: SparkSession, d: str) -> DataFrame:
    """Delimited files, lists as JSON, read by the places of their columns."""
    at = workspace(spark, "csv")
    sinks.table(read(spark, d, "livre").select("id_livre", "titre", "annee", "auteurs"), at)
    r = readers.delimited(spark, at, ["id_livre", "titre", "annee", "auteurs"])
    return _full(r.withColumn("auteurs", F.array_join(F.from_json("auteurs", "array<string>"), ";")))


@query(r"SELECT CAST(id_livre AS VARCHAR) id_livre, coalesce(regexp_replace(titre, '[^\x00-\xff]', '?', 'g'), '') titre, coalesce(langue, '') langue FROM livre")
def csv_latin(spark: SparkSession, d: str) -> DataFrame:
    """A semicolon file in Latin-1 without header; characters that Latin-1 lacks are question marks."""
    at = workspace(spark, "latin")
    sinks.table(read(spark, d, "livre").select("id_livre", "titre", "langue"), at, ";", header=False, encoding="ISO-8859-1")
    return _full(readers.delimited(spark, at, ["id_livre", "titre", "langue"], ";", header=False, encoding="ISO-8859-1"))


@query(r"SELECT CAST(no_ligne AS VARCHAR) no_ligne, coalesce(regexp_replace(titre, '[^\x00-\xff]', '?', 'g'), '') titre, coalesce(regexp_replace(resume, '[^\x00-\xff]', '?', 'g'), '') resume FROM exportation_hurtubise")
def csv_latin_header(spark: SparkSession, d: str) -> DataFrame:
    """The same with a header, which is skipped."""
    at = workspace(spark, "latin")
    sinks.table(read(spark, d, "exportation_hurtubise").select("no_ligne", "titre", "resume"), at, ";", encoding="ISO-8859-1")
    return _full(readers.delimited(spark, at, ["no_ligne", "titre", "resume"], ";", encoding="ISO-8859-1"))


@query("SELECT CAST(no_ligne AS VARCHAR) no_ligne, coalesce(titre_publication, '') titre_publication, coalesce(liste_auteur, '') liste_auteur FROM depotlegal20171231")
def csv_by_header(spark: SparkSession, d: str) -> DataFrame:
    """A delimited file by the names of its header."""
    at = workspace(spark, "header")
    sinks.table(read(spark, d, "depotlegal20171231").select("no_ligne", "titre_publication", "liste_auteur"), at)
    return _full(readers.by_header(spark, at))


_LINE = "trim(replace(replace(regexp_replace(coalesce({0}, ''), '\t+', ' ', 'g'), chr(10), ''), chr(13), ''))"


def _line(c: str) -> Column:
    return F.replace(text.clean_blanks(F.coalesce(F.col(c), F.lit(""))), F.lit("\r"), F.lit("")).alias(c)


@query(f"SELECT auteur_key, {_LINE.format('nom')} nom, {_LINE.format('prenom')} prenom, {_LINE.format('lieu_naissance')} lieu FROM auteur")
def ragged_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of fields parted by a text of its own."""
    at = workspace(spark, "ragged")
    sinks.lines(read(spark, d, "auteur").select("auteur_key", _line("nom"), _line("prenom"), _line("lieu_naissance")), at, "<>")
    return readers.ragged(spark, at, ["auteur_key", "nom", "prenom", "lieu"])


@query(f"SELECT auteur_key, {_LINE.format('nom')} nom FROM auteur")
def parted_records(spark: SparkSession, d: str) -> DataFrame:
    """Records parted by a text instead of line ends."""
    at = workspace(spark, "records")
    read(spark, d, "auteur").select(F.concat_ws("<>", "auteur_key", _line("nom")).alias("value")).write.option("lineSep", "<!>").text(at)
    return readers.ragged(spark, at, ["auteur_key", "nom"], record="<!>")


@query("SELECT r_name first, n_name AS last FROM region JOIN nation ON r_regionkey = n_regionkey")
def line_lists(spark: SparkSession, d: str) -> DataFrame:
    """First and last field of the lines of a list."""
    at = workspace(spark, "list")
    rows = read(spark, d, "region").join(read(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "n_nationkey", "n_name")
    sinks.lines(rows, at)
    last = readers.line_list(spark, at, last=True).select(F.col("value").alias("last"))
    named = rows.select(F.col("r_name").alias("first"), F.col("n_name").alias("last"))
    return last.join(named, "last").join(readers.line_list(spark, at).distinct().withColumnRenamed("value", "first"), "first").select("first", "last")


@query("SELECT isbn || ', ' || concat_ws(', ', coalesce(adp, ''), coalesce(ile, ''), coalesce(depot, ''), coalesce(hurtubise, ''), coalesce(babelio, '')) AS value FROM (WITH " + f"{q.BOOKS}, {q.ALIGNED}" + " SELECT * FROM counted WHERE n_sources >= 2) WHERE NOT regexp_matches(concat_ws(' ', adp, ile, depot, hurtubise, babelio), '[\r\n]')")
def alignment_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the alignment file."""
    books = match.library_books(read(spark, d, "livre"), read(spark, d, "babelio_book"))
    at = workspace(spark, "alignment")
    align.alignment_lines(align.overlapping(align.align(align.isbn_titles(books)), "any_overlap")).where(~F.col("value").rlike("[\r\n]")).write.text(at)
    return spark.read.text(at)


@query("SELECT n_name a, r_name b FROM nation JOIN region ON n_regionkey = r_regionkey")
def pairs_both_ways(spark: SparkSession, d: str) -> DataFrame:
    """Pairs as a file without header and as a table of arrays: both give the same."""
    rows = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("a"), F.col("r_name").alias("b"))
    one, two = workspace(spark, "pairs"), workspace(spark, "pairs")
    sinks.table(rows, one, header=False)
    rows.select(F.array("a", "b").alias("pair")).write.parquet(two)
    return readers.delimited(spark, one, ["a", "b"], header=False).intersect(spark.read.parquet(two).select(F.get("pair", 0).alias("a"), F.get("pair", 1).alias("b")))


@query("SELECT c_name, c_mktsegment, CAST(row_number() OVER (ORDER BY c_name) AS BIGINT) place FROM customer")
def sorted_list(spark: SparkSession, d: str) -> DataFrame:
    """A master list in order of the names: the places of its lines are those of the order."""
    at = workspace(spark, "sorted")
    sinks.sorted_table(read(spark, d, "customer").select("c_name", "c_mktsegment"), at, "c_name")
    r = spark.read.csv(at, sep="|", header=True).withColumn("file", F.input_file_name())
    return mlprep.numbered(r, [F.col("file"), F.col("c_name")], "place").select("c_name", "c_mktsegment", "place")


@query("SELECT event_type property, round(avg(n), 6) non_null_mean, count(*) nb_non_null, CAST(sum(n) AS BIGINT) total FROM (SELECT event_type, user_id, count(*) n FROM events GROUP BY 1, 2) GROUP BY 1")
def property_file(spark: SparkSession, d: str) -> DataFrame:
    """The summary of properties as a file."""
    at = workspace(spark, "properties")
    sinks.table(profile.property_summary(read(spark, d, "events"), "user_id", "event_type"), at)
    return readers.by_header(spark, at).select("property", F.col("non_null_mean").cast("double").alias("non_null_mean"), F.col("nb_non_null").cast("long").alias("nb_non_null"), F.col("total").cast("long").alias("total"))


@query(f"SELECT author_key, coalesce(replace(regexp_replace(bio, '\t+', ' ', 'g'), chr(10), ''), '') bio, 2 AS copies FROM babelio_author WHERE bio IS NOT NULL AND NOT contains(bio, chr(92)) AND NOT contains(bio, chr(13))")
def converted_lists(spark: SparkSession, d: str) -> DataFrame:
    """A list appended twice to a comma file, commas of bios with a backslash; read back without it."""
    at = workspace(spark, "converted")
    rows = read(spark, d, "babelio_author").where("bio is not null").where(~F.col("bio").contains("\\") & ~F.col("bio").contains("\r")).select("author_key", text.clean_blanks(F.col("bio")).alias("bio"))
    sinks.convert(rows, at, ("bio",))
    sinks.convert(rows, at, ("bio",))
    r = readers.delimited(spark, at, ["author_key", "bio"], header=False)
    return r.select("author_key", F.coalesce(F.replace("bio", F.lit("\\,"), F.lit(",")), F.lit("")).alias("bio")).groupBy("author_key", "bio").agg(F.count("*").cast("int").alias("copies"))


# --- JSON -----------------------------------------------------------------------------------------------------


@query("SELECT rec_id, title, coalesce(array_to_string(author, ';'), '') author, coalesce(len(reviews), 0) reviews, 'BabelioBook' AS class FROM babelio_book")
def json_items(spark: SparkSession, d: str) -> DataFrame:
    """Items with a class mark as arrays of objects."""
    at = workspace(spark, "items")
    sinks.json_array(read(spark, d, "babelio_book").select("rec_id", "title", "author", "reviews", F.lit("BabelioBook").alias("__class__")), at)
    r = readers.items(spark, at, "rec_id long, title string, author array<string>, reviews array<struct<id:string,content:string>>, __class__ string")
    return r.select("rec_id", "title", F.coalesce(F.array_join("author", ";"), F.lit("")).alias("author"), F.coalesce(F.when(F.col("reviews").isNotNull(), F.size("reviews")), F.lit(0)).alias("reviews"), "class")


@query("SELECT author_key, name, coalesce(array_to_string(awards, ';'), '') awards FROM babelio_author")
def feed_export(spark: SparkSession, d: str) -> DataFrame:
    """Items of a crawl, one object a line."""
    at = workspace(spark, "feed")
    sinks.json(read(spark, d, "babelio_author").select("author_key", "name", "awards"), at)
    return spark.read.schema("author_key string, name string, awards array<string>").json(at).select("author_key", "name", F.coalesce(F.array_join("awards", ";"), F.lit("")).alias("awards"))


@query("SELECT r_name AS name, array_to_string(list(n_name ORDER BY n_name), ';') AS value FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def keyed_json(spark: SparkSession, d: str) -> DataFrame:
    """An object keyed by names."""
    at = workspace(spark, "keyed")
    rows = read(spark, d, "region").join(read(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("v"))
    rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", "v")))).alias("value")).write.text(at)
    return readers.keyed_items(spark, at, "array<string>").select("name", F.array_join("value", ";").alias("value"))


@query("SELECT c_mktsegment segment, count(*) n FROM customer GROUP BY 1")
def statistics_file(spark: SparkSession, d: str) -> DataFrame:
    """Counts as indented JSON."""
    at = workspace(spark, "statistics")
    sinks.statistics(read(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n")), at)
    return spark.read.text(at, lineSep="\n\n").where("value <> ''").select(F.from_json("value", "segment string, n long").alias("x")).select("x.*")


@query("SELECT code, label AS label, parent FROM (SELECT 'R' || r_regionkey code, r_name AS label, NULL parent FROM region UNION ALL SELECT 'N' || n_nationkey, n_name, 'R' || n_regionkey FROM nation)")
def subject_codes(spark: SparkSession, d: str) -> DataFrame:
    """A subject code list, one file a list."""
    at = workspace(spark, "codes")
    r = read(spark, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("CodeValue"), F.col("r_name").alias("CodeDescription"), F.lit(None).cast("string").alias("CodeParent"))
    r = r.union(read(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey"), "n_name", F.concat(F.lit("R"), "n_regionkey")))
    r.agg(F.to_json(F.struct(F.struct(F.struct(F.collect_list(F.struct("*")).alias("Code")).alias("ThemaCodes")).alias("CodeList"))).alias("value")).write.text(at)
    return readers.codes(spark, at)


@query("SELECT CAST(couple_id AS VARCHAR) id, author_db.name AS author, author_wiki.name AS label FROM couple_writers")
def endpoint_answer(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a query endpoint's answer; a variable may be unbound."""
    at = workspace(spark, "bindings")
    value = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.lit("literal").alias("type"), F.col(c).cast("string").alias("value")))
    rows = read(spark, d, "couple_writers").select(F.pmod("couple_id", F.lit(16)).alias("page"), F.struct(value("couple_id").alias("id"), value("author_db.name").alias("author"), value("author_wiki.name").alias("label")).alias("b"))
    rows.groupBy("page").agg(F.to_json(F.struct(F.struct(F.collect_list("b").alias("bindings")).alias("results"))).alias("value")).select("value").write.text(at)
    r = spark.read.schema("results struct<bindings:array<struct<id:struct<value:string>,author:struct<value:string>,label:struct<value:string>>>>").json(at)
    return readers.bound(r)


# --- vectors --------------------------------------------------------------------------------------------------


@query("SELECT CAST(vec_id AS VARCHAR) token, CAST(generate_subscripts(embedding, 1) - 1 AS INT) i, round(CAST(unnest(embedding) AS DOUBLE), 6) x FROM embeddings")
def vector_file(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as lines of text, six places each."""
    at = workspace(spark, "vectors")
    sinks.vectors(read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("token"), F.col("embedding").cast("array<double>").alias("vector")), at)
    return readers.vectors(spark, at).select("token", F.posexplode("vector").alias("i", "x"))


@query("SELECT ch, CAST(i AS INT) i, round(avg(x), 6) mean FROM (SELECT ch, unnest(v) x, generate_subscripts(v, 1) - 1 i FROM (SELECT unnest(string_split(CAST(vec_id AS VARCHAR), '')) ch, embedding v FROM embeddings)) WHERE ch <> '' GROUP BY 1, 2")
def character_vectors(spark: SparkSession, d: str) -> DataFrame:
    """For each character the mean vector of the tokens that hold it."""
    return mlprep.character_means(read(spark, d, "embeddings").withColumn("token", F.col("vec_id").cast("string")), "token", "embedding")


@query("SELECT count(*) tokens, count(*) FILTER (token IN (SELECT CAST(vec_id AS VARCHAR) FROM embeddings)) found FROM (SELECT DISTINCT unnest(string_split(text, '')) token FROM eval_item) WHERE token <> ''")
def embedding_lookup(spark: SparkSession, d: str) -> DataFrame:
    """How many tokens of a vocabulary have a vector."""
    vocab = mlprep.distinct_characters(read(spark, d, "eval_item"), "text")
    vectors = read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("token"), F.col("embedding").alias("vector"))
    return mlprep.embedding_matrix(vocab, vectors).agg(F.count("*").alias("tokens"), F.count("vector").alias("found"))


@query("SELECT n_regionkey, count(*) n FROM nation GROUP BY 1")
def kept_table(spark: SparkSession, d: str) -> DataFrame:
    """A table that is made once and read from then on."""
    at = workspace(spark, "kept")
    make = lambda: read(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    readers.cached(spark, at, make)
    return readers.cached(spark, at, lambda: make().limit(0))


# --- graphs and XML -------------------------------------------------------------------------------------------

_XML_OK = "NOT regexp_matches(o, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')"


@query(f"WITH {_T.format('depot')} SELECT s, p, o, CASE WHEN p = '{graph.RDF_TYPE}' THEN 'uri' ELSE 'literal' END o_kind, CASE WHEN p = '{_NS}name' THEN 'fr' END o_lang FROM t WHERE {_XML_OK}")
def rdf_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A graph written as RDF/XML and read again: kinds and languages of objects stay."""
    at = workspace(spark, "rdf")
    t = _graph(spark, d, "depot")
    sinks.rdf_xml(t.where(~F.col("o").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")), at)
    return readers.rdf_xml(spark, at).select("s", "p", "o", "o_kind", "o_lang")


_NT = r"""replace(replace(replace(o, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n')"""


@query(f"""WITH {_T.format('adp')} SELECT '<' || s || '> <' || p || '> ' || CASE WHEN p = '{graph.RDF_TYPE}' THEN '<' || o || '>' WHEN p = '{_NS}name' THEN '"' || {_NT} || '"@fr' ELSE '"' || {_NT} || '"' END || ' .' AS value FROM t WHERE NOT contains(o, chr(13))""")
def n_triples_file(spark: SparkSession, d: str) -> DataFrame:
    """A graph as N-Triples lines."""
    at = workspace(spark, "nt")
    sinks.n_triples(_graph(spark, d, "adp").where(~F.col("o").contains("\r")), at)
    return spark.read.text(at)


def _escaped(c: Column) -> Column:
    c = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _onix(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "exportation_hurtubise")
    e = lambda name, c: F.concat(F.lit(f"<{name}>"), _escaped(c if isinstance(c, Column) else F.lit(c)), F.lit(f"</{name}>"))
    wrap = lambda name, *cs: F.concat(F.lit(f"<{name}>"), *cs, F.lit(f"</{name}>"))
    xml = wrap(
        "Product",
        wrap("ProductIdentifier", e("ProductIDType", "15"), e("IDValue", F.col("isbn_papier"))),
        wrap("DescriptiveDetail", wrap("TitleDetail", wrap("TitleElement", e("TitleText", F.trim(F.regexp_replace("titre", r"\s+", " "))))), wrap("Language", e("LanguageRole", "01"), e("LanguageCode", F.col("langue"))), wrap("Subject", F.lit("<MainSubject/>"), e("SubjectSchemeIdentifier", "93"), e("SubjectCode", F.col("sujet_thema_principal")))),
        F.when(F.col("editeur").isNotNull(), wrap("PublishingDetail", wrap("Publisher", e("PublishingRole", "01"), e("PublisherName", F.col("editeur"))))).otherwise(F.lit("")),
    )
    return r.select("no_ligne", xml.alias("xml"))


@query("SELECT no_ligne, coalesce(isbn_papier, '') isbn, trim(regexp_replace(coalesce(titre, ''), '\\s+', ' ', 'g')) title, coalesce(langue, '') AS language, coalesce(sujet_thema_principal, '') thema, editeur publisher FROM exportation_hurtubise WHERE editeur IS NOT NULL")
def product_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of product descriptions; those without publishing detail are left out."""
    r = readers.onix(_onix(spark, d), "no_ligne")
    return r.select("no_ligne", *[F.coalesce(F.get(c, 0), F.lit("")).alias(n) for n, c in (("isbn", "isbn"), ("title", "title"), ("language", "language"), ("thema", "main_thema"), ("publisher", "publisher"))])


@query("SELECT f AS field, v AS value, count(*) n FROM (SELECT 'language' f, langue v FROM exportation_hurtubise UNION ALL SELECT 'main_thema', sujet_thema_principal FROM exportation_hurtubise) WHERE v <> '' GROUP BY 1, 2")
def product_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often values stand at paths of product descriptions."""
    return readers.xml_counts(_onix(spark, d), "xml", {n: readers.ONIX[n] for n in ("language", "main_thema")})


@query("SELECT CAST(no_ligne AS VARCHAR) code, CASE WHEN editeur IS NULL THEN 'ERREUR ' || no_ligne ELSE editeur END answer FROM exportation_hurtubise")
def fetched_products(spark: SparkSession, d: str) -> DataFrame:
    """Landed answers of a product store, an error line where there is none."""
    r = read(spark, d, "exportation_hurtubise").select(F.col("no_ligne").cast("string").alias("code"), F.when(F.col("editeur").isNull(), 404).otherwise(200).alias("status"), F.col("editeur").alias("xml"))
    return readers.fetched(r)


_CODED = " UNION ALL ".join(f"SELECT {q.quote(n)} list, {q.quote(k)} code, {q.quote(v)} meaning" for n, t in text.ONIX_CODES.items() for k, v in t.items())


@query(f"SELECT no_ligne, list, meaning FROM exportation_hurtubise JOIN ({_CODED}) ON code = lpad(CAST(no_ligne % 20 AS VARCHAR), 2, '0')")
def product_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes of product descriptions and their meaning, by list."""
    r = read(spark, d, "exportation_hurtubise").withColumn("code", F.lpad((F.col("no_ligne") % 20).cast("string"), 2, "0"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("list"), text.lookup(F.col("code"), t).alias("meaning")) for n, t in text.ONIX_CODES.items()]))
    return r.select("no_ligne", each.alias("x")).select("no_ligne", "x.*").where("meaning is not null")


# --- pages ----------------------------------------------------------------------------------------------------

_ONE = "trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))"


def _one(c: str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))


def _tag(name: str, inner: Column, **attrs: str) -> Column:
    told = "".join(f' {k.rstrip("_")}="{v}"' for k, v in attrs.items())
    return F.concat(F.lit(f"<{name}{told}>"), inner, F.lit(f"</{name}>"))


def _page(spark: SparkSession, d: str) -> DataFrame:
    b = read(spark, d, "babelio_book")
    made = F.concat(
        _tag("h1", _tag("a", _escaped(_one("title")))),
        _tag("div", F.concat(_escaped(_one("infos")), _tag("a", _escaped(_one("editor")))), class_="livre_refs"),
        _tag("span", _escaped(_one("rating")), class_="texte_t2", itemprop="ratingValue"),
        _tag("div", _escaped(_one("resume")), class_="livre_resume", id="d_bio"),
        _tag("p", F.array_join(F.transform(F.filter(F.coalesce("tags", F.array()), lambda t: t.tag.isNotNull()), lambda t: F.concat(F.lit('<a class="'), F.coalesce(t.info, F.lit("")), F.lit('">'), _escaped(F.trim(F.regexp_replace(t.tag, r"\s+", " "))), F.lit("</a>"))), ""), class_="tags"),
    )
    return b.select("rec_id", made.alias("html"))


@query(f"SELECT rec_id, nullif({_ONE.format('title')}, '') title, nullif({_ONE.format('editor')}, '') editor, nullif({_ONE.format('rating')}, '') rating, {_ONE.format('resume')} resume, len(list_filter(coalesce(tags, []), lambda t: t.tag IS NOT NULL)) tags FROM babelio_book")
def book_pages(spark: SparkSession, d: str) -> DataFrame:
    """Fields of book pages out of their markup."""
    r = html.parsed(_page(spark, d), "rec_id", "html", "book_page").select("rec_id", "found.*")
    return r.select("rec_id", "title", "editor", "rating", "resume", F.size("tags").cast("long").alias("tags"))


@query(f"SELECT author_key, nullif({_ONE.format('name')}, '') AS name, {_ONE.format('bio')} bio, len(list_filter(coalesce(bibliography, []), lambda x: x IS NOT NULL)) works FROM babelio_author")
def author_pages(spark: SparkSession, d: str) -> DataFrame:
    """Fields of author pages out of their markup."""
    a = read(spark, d, "babelio_author")
    works = F.array_join(F.transform(F.filter(F.coalesce("bibliography", F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: F.lit('<td class="titre_livre"><a class="titre_v2" href="/livres/x">t</a></td>')), "")
    page = F.concat(_tag("h1", _tag("a", _escaped(_one("name")))), _tag("div", _escaped(_one("bio")), id="d_bio"), works)
    r = html.parsed(a.select("author_key", page.alias("html")), "author_key", "html", "author_page").select("author_key", "found.*")
    return r.select("author_key", "name", "bio", F.size("bibliography").cast("long").alias("works"))


@query(f"SELECT rec_id, r.id, {_ONE.format('r.date')} AS date, r.rating FROM (SELECT rec_id, unnest(reviews) r FROM babelio_book) WHERE r.id IS NOT NULL AND r.rating IS NOT NULL AND {_ONE.format('r.date')} <> ''")
def review_pages(spark: SparkSession, d: str) -> DataFrame:
    """Reviews out of the markup of their pages, one page a book."""
    each = read(spark, d, "babelio_book").select("rec_id", F.explode("reviews").alias("r")).where("r.id is not null and r.rating is not null").withColumn("date", _one("r.date")).where("date <> ''")
    post = F.concat(F.lit('<div class="post_con" id="'), _escaped(F.col("r.id")), F.lit('"><div class="no_img"><span class="gris">'), _escaped(F.col("date")), F.lit('</span></div><div class="rateit" data-rateit-value="'), F.col("r.rating"), F.lit('"></div></div>'))
    pages = each.select("rec_id", F.xxhash64("r.id").alias("page"), post.alias("html"))
    r = html.gathered(pages, "rec_id", "page", "html", "reviews")
    return r.select("rec_id", F.explode("found").alias("x")).select("rec_id", "x.id", "x.date", "x.rating")


@query(f"SELECT rec_id, nullif({_ONE.format('title')}, '') title, '/livres/' || rec_id AS href FROM babelio_book")
def search_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a search page: titles and where they lead."""
    page = F.concat(F.lit('<table><tr><td class="titre_livre"><a class="titre_v2" href="/livres/'), F.col("rec_id").cast("string"), F.lit('">'), _escaped(_one("title")), F.lit("</a></td></tr></table>"))
    r = html.parsed(read(spark, d, "babelio_book").select("rec_id", page.alias("html")), "rec_id", "html", "hits")
    return r.select("rec_id", F.explode("found").alias("x")).select("rec_id", "x.title", "x.href")


@query(f"SELECT id_livre, nullif({_ONE.format('titre')}, '') title, nullif({_ONE.format('annee')}, '') \"year\", nullif({_ONE.format('editeur')}, '') publisher FROM livre WHERE source = 'ile'")
def notice_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards of labelled values, as a list of terms and descriptions."""
    r = read(spark, d, "livre").where("source = 'ile'")
    card = _tag("dl", F.concat(*[F.concat(_tag("dt", F.lit(n)), _tag("dd", _escaped(_one(c)))) for n, c in (("Titre", "titre"), ("Année", "annee"), ("Éditeur", "editeur"))]))
    m = html.parsed(r.select("id_livre", card.alias("html")), "id_livre", "html", "card")
    get = lambda n: F.nullif(F.try_element_at("found", F.lit(n)), F.lit(""))
    return m.select("id_livre", get("Titre").alias("title"), get("Année").alias("year"), get("Éditeur").alias("publisher"))


# --- wikitext -------------------------------------------------------------------------------------------------

_CLEAN = "trim(regexp_replace(regexp_replace(coalesce({0}, ''), '[^\\p{{L}}\\p{{N}} ]', '', 'g'), ' +', ' ', 'g'))"


def _clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N} ]", ""), " +", " "))


def _wiki(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "babelio_author")
    works = F.array_join(F.transform(F.coalesce("bibliography", F.array().cast("array<string>")), lambda x: F.concat(F.lit("* 1999 : ''"), _clean(x), F.lit("'', Montréal\n"))), "")
    page = F.concat(F.lit("{{Infobox Écrivain\n| nom=W"), _clean(F.col("name")), F.lit("\n| lieu=L"), _clean(F.col("place_of_birth")), F.lit("\n}}\nIntro\n== Œuvres ==\n=== Romans ===\n"), works, F.lit("== Prix ==\n* [[Prix X|un prix]]\n"))
    return a.select(F.col("author_key").alias("title"), page.alias("text"))


@query(f"SELECT author_key title, 'W' || {_CLEAN.format('name')} AS nom, 'L' || {_CLEAN.format('place_of_birth')} lieu FROM babelio_author")
def infoboxes(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the infoboxes of a dump's pages."""
    at = workspace(spark, "dump")
    t = _wiki(spark, d).select("title", F.struct(F.struct(F.col("text").alias("_VALUE"), F.lit("preserve").alias("_space")).alias("text")).alias("revision"))
    t.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(at)
    r = wiki.wiki_pages(readers.wiki_dump(spark, at))
    box = lambda n: F.trim(F.try_element_at("infobox", F.lit(n)))
    return r.select("title", box(" nom").alias("nom"), box(" lieu").alias("lieu")).distinct()


@query("SELECT s AS section, l AS level, count(*) n FROM (SELECT unnest(['Œuvres', 'Romans', 'Prix']) s, unnest([2, 3, 2]) l FROM babelio_author) GROUP BY 1, 2")
def wiki_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of pages by their levels."""
    return wiki.wiki_pages(_wiki(spark, d)).groupBy(F.element_at("path", -1).alias("section"), "level").agg(F.count("*").alias("n"))


@query("SELECT s AS section, count(*) n FROM (SELECT unnest(['Œuvres', 'Prix']) s FROM babelio_author) GROUP BY 1")
def section_frequency(spark: SparkSession, d: str) -> DataFrame:
    """How often sections down to level 2 have each title."""
    return wiki.section_titles(wiki.wiki_pages(_wiki(spark, d)))


@query(f"SELECT author_key title, w AS work FROM (SELECT author_key, {_CLEAN.format('b')} w FROM (SELECT author_key, unnest(bibliography) b FROM babelio_author)) WHERE w <> ''")
def works_listed(spark: SparkSession, d: str) -> DataFrame:
    """Titles of works in the sections below one about works."""
    r = wiki.wiki_pages(_wiki(spark, d)).where(F.exists("path", lambda p: p.rlike(wiki.WORKS)))
    return r.select("title", F.explode("works").alias("work"))


@query("SELECT count(*) writers, count(*) awards, 0::BIGINT books FROM babelio_author")
def page_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Pages of writers and of books, and sections about awards."""
    w = _wiki(spark, d)
    awards = wiki.wiki_pages(w).where(F.element_at("path", -1).rlike(wiki.AWARDS)).count()
    return w.agg(F.count_if(wiki.is_writer(F.col("text"))).alias("writers"), F.lit(awards).cast("long").alias("awards"), F.count_if(wiki.is_book(F.col("text"))).alias("books"))


@query("SELECT author_key title, 'Œuvres' parent, 'Romans' AS section FROM babelio_author")
def works_subsections(spark: SparkSession, d: str) -> DataFrame:
    """Sections one level below those about works."""
    return wiki.subsections(wiki.wiki_pages(_wiki(spark, d)), wiki.WORKS)
