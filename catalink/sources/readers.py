"""Readers of the catalogue's source formats. Every value of a delimited source is a text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the delimited sources in the order in which they are written.
LEGAL_DEPOSIT = [
    "ID_DEPOT", "TITRE_PUBLICATION", "ANNEE_PUBLICATION", "STATUT_REQUETE", "DATE_ENREGISTREMENT", "CODE_EDITEUR", "NOM_EDITEUR",
    "CATEGORIE_EDITEUR", "TYPE_DOCUMENT", "TYPEPUBLICATION", "LANGUE_PUBLICATION", "LANGUE_ORIGINALE", "CATEGORIE_SUJET",
    "SUJET", "COEDITION", "PERIODICITE", "ETAT_PERIODICITE", "LISTE_ISBN_NETTOYE", "LISTE_AUTEUR", "EST_NUMERIQUE",
]
PUBLISHER_EXPORT = [
    "Editeur", "ISBN Papier", "ISBN PDF", "ISBN epub", "Titre", "Sous - titre", "Titre de la serie", "Contributeurs", "Contributeur(premier)", "Langue",
    "Langue Origine", "Resume", "Nombre de pages", "Date de parution", "Annee de parution", "Sujet  THEMA principal", "Sujet THEMA", "Quantificateur Georaphique",
    "Quantificateur de langue", "Quantificateur Historique", "Niveau soclaire FR", "Niveau scolaire QC", "Cycle scolaire FR", "Niveau de lecture", "Echele CECR",
    "Quantificateur d'interet", "Quantificateur d'age", "Quantificateur de style", "Classification Editoriale", "Mots cles",
]
ILE_AUTHORS = ["uri", "nom", "bio", "genres", "site", "pseudonyme"]
ILE_AUTHORS_TEXT = ["uri", "nom", "genres", "pseudonyme", "site", "bio"]
ILE_WORKS = ["id", "title", "datePublished", "author_uri", "edition", "publication_place", "isbn"]
WRITERS = ["NOM", "ILE", "UNEQ", "WIKIDATA", "DBPEDIA-EN", "DBPEDIA-FR"]
ALIGNMENT = ["isbn", "adp", "ile", "depot", "hurtubise", "babelio"]


def texts(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def delimited(spark: SparkSession, path: str, columns: list[str], sep: str = ",", header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """A delimited file with the columns given, by place; a header line is skipped, not read for names."""
    return spark.read.csv(path, schema=texts(columns), sep=sep, header=header, enforceSchema=True, encoding=encoding, quote='"', escape='"', multiLine=True, nullValue="\x00")


def by_header(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A delimited file by the names of its header."""
    return spark.read.csv(path, sep=sep, header=True, encoding=encoding, quote='"', escape='"', multiLine=True)


def ragged(spark: SparkSession, path: str, columns: list[str], sep: str = "<>", record: str = "\n") -> DataFrame:
    """Records parted by a text and fields parted by another; fields a record lacks are null."""
    lines = spark.read.text(path, lineSep=record).where(F.length(F.trim("value")) > 0)
    parts = F.split("value", "\\Q" + sep + "\\E")
    return lines.select(*[F.trim(F.get(parts, i)).alias(c) for i, c in enumerate(columns)])


def line_list(spark: SparkSession, path: str, sep: str = " ; ", last: bool = False) -> DataFrame:
    """First or last field of each line."""
    parts = F.split("value", "\\Q" + sep + "\\E")
    return spark.read.text(path).where("value <> ''").select((F.element_at(parts, -1) if last else F.get(parts, 0)).alias("value"))


def items(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Files with one JSON array of objects each; a class mark within them comes out as the column `class`."""
    reader = spark.read.option("multiLine", True)
    rows = (reader.schema(schema) if schema else reader).json(path)
    return rows.withColumnRenamed("__class__", "class")


def keyed_items(spark: SparkSession, path: str, values: str) -> DataFrame:
    """(name, value): a JSON object keyed by names, its values of the type given."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{values}>")).alias("name", "value"))


def codes(spark: SparkSession, path: str) -> DataFrame:
    """(code, label, parent) of a subject code list."""
    schema = "CodeList struct<ThemaCodes:struct<Code:array<struct<CodeValue:string,CodeDescription:string,CodeParent:string>>>>"
    rows = spark.read.option("multiLine", True).schema(schema).json(path)
    return rows.select(F.explode("CodeList.ThemaCodes.Code").alias("c")).select(F.col("c.CodeValue").alias("code"), F.col("c.CodeDescription").alias("label"), F.col("c.CodeParent").alias("parent"))


def wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """(title, text) of the pages of a dump."""
    schema = "title string, revision struct<text:struct<_VALUE:string,`_xml:space`:string>>"
    rows = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return rows.select("title", F.col("revision.text._VALUE").alias("text"))


_RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"


def rdf_xml(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, o_kind, o_datatype, o_lang): triples of RDF/XML files, with whole names of properties.

    Elements are read one subject at a time as the parser meets them, so a file of any length fits in a task; a
    typed element gives its type as a triple. Relative and repeated subjects stay as written.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        from xml.etree.ElementTree import iterparse

        columns = ["s", "p", "o", "o_kind", "o_datatype", "o_lang"]
        whole = lambda tag: tag[1:].replace("}", "", 1)
        for batch in batches:
            for content in batch["content"]:
                out, depth = [], 0
                for event, e in iterparse(io.BytesIO(content), ("start", "end")):
                    depth += 1 if event == "start" else -1
                    if event == "start" or depth != 1:
                        continue
                    blank = e.get(_RDF + "nodeID")
                    s = "_:" + blank if blank else e.get(_RDF + "about") or ""
                    if e.tag != _RDF + "Description":
                        out.append((s, whole(_RDF + "type"), whole(e.tag), "uri", None, None))
                    for x in e:
                        to, node = x.get(_RDF + "resource"), x.get(_RDF + "nodeID")
                        kind = "uri" if to is not None else "blank" if node else "literal"
                        o = to if kind == "uri" else "_:" + node if node else x.text or ""
                        out.append((s, whole(x.tag), o, kind, x.get(_RDF + "datatype"), x.get("{http://www.w3.org/XML/1998/namespace}lang")))
                    e.clear()
                    if len(out) >= 10_000:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
                yield pd.DataFrame(out, columns=columns)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "s string, p string, o string, o_kind string, o_datatype string, o_lang string").distinct()


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """(token, vector): a text file of embeddings; a first line of two numbers and broken lines are left out."""
    parts = F.split(F.trim("value"), " ")
    rows = spark.read.text(path).select(F.get(parts, 0).alias("token"), F.transform(F.slice(parts, 2, F.size(parts)), lambda x: x.try_cast("double")).alias("vector"))
    return rows.where((F.size("vector") > 1) & ~F.exists("vector", lambda x: x.isNull()))


def bindings(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a query endpoint's JSON answer: one column per variable."""
    return bound(spark.read.option("multiLine", True).json(path))


def bound(answers: DataFrame) -> DataFrame:
    """The same of answers that are already read, with a known type."""
    rows = answers.select(F.explode("results.bindings").alias("b"))
    names = rows.schema["b"].dataType.fieldNames()
    return rows.select(*[F.col(f"b.`{n}`.value").alias(n) for n in names])


def cached(spark: SparkSession, path: str, make) -> DataFrame:  # noqa: ANN001
    """What a Parquet folder holds, or what make() gives, written there first.

    The rows are written beside it and moved into place in one step; of two jobs that write, the later one reads
    what the first has put there.
    """
    import uuid

    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
        make().write.parquet(beside)
        made = jvm.org.apache.hadoop.fs.Path(beside)
        if fs.exists(at) or not fs.rename(made, at):
            fs.delete(made, True)
    return spark.read.parquet(path)


#: Paths within product descriptions, by field.
ONIX = {
    "isbn": "Product/ProductIdentifier[ProductIDType='15']/IDValue/text()",
    "title": "Product/DescriptiveDetail/TitleDetail/TitleElement/TitleText/text()",
    "authors": "Product/DescriptiveDetail/Contributor[ContributorRole='A01']/PersonName/text()",
    "bios": "Product/DescriptiveDetail/Contributor/BiographicalNote/text()",
    "language": "Product/DescriptiveDetail/Language[LanguageRole='01']/LanguageCode/text()",
    "thema": "Product/DescriptiveDetail/Subject[SubjectSchemeIdentifier='93']/SubjectCode/text()",
    "main_thema": "Product/DescriptiveDetail/Subject[MainSubject and SubjectSchemeIdentifier='93']/SubjectCode/text()",
    "publisher": "Product/PublishingDetail/Publisher[PublishingRole='01']/PublisherName/text()",
    "description": "Product/CollateralDetail/TextContent[TextType='03']/Text/text()",
    "review": "Product/CollateralDetail/TextContent[TextType='06']/Text/text()",
    "promotion": "Product/CollateralDetail/TextContent[TextType='10']/Text/text()",
    "published": "Product/PublishingDetail/PublishingDate/Date/text()",
    "identifiers": "Product/ProductIdentifier/IDValue/text()",
    "bisac": "Product/DescriptiveDetail/Subject[SubjectSchemeIdentifier='10']/SubjectCode/text()",
    "own_category": "Product/DescriptiveDetail/Subject[SubjectSchemeIdentifier='23']/SubjectCode/text()",
}


def onix(rows: DataFrame, code: str = "code", xml: str = "xml") -> DataFrame:
    """The fields of product descriptions as lists of texts; descriptions without publishing or descriptive detail are left out."""
    whole = rows.where(F.expr(f"xpath_boolean({xml}, 'Product/PublishingDetail') and xpath_boolean({xml}, 'Product/DescriptiveDetail')"))
    return whole.select(code, *[F.expr(f'xpath({xml}, "{p}")').alias(n) for n, p in ONIX.items()])


def fetched(rows: DataFrame, code: str = "code", status: str = "status", body: str = "xml") -> DataFrame:
    """(code, answer): what a product store answered for each code; any other status than 200 gives an error line."""
    return rows.select(code, F.when(F.col(status) == 200, F.col(body)).otherwise(F.concat(F.lit("ERREUR "), F.col(code))).alias("answer"))


def xml_counts(rows: DataFrame, xml: str, paths: dict[str, str]) -> DataFrame:
    """(field, value, n): how often each value stands at each path of XML texts."""

    def at(n: str, p: str) -> Column:
        return F.transform(F.expr(f'xpath({xml}, "{p}")'), lambda v: F.struct(F.lit(n).alias("field"), v.alias("value")))

    each = F.flatten(F.array(*[at(n, p) for n, p in paths.items()]))
    return rows.select(F.explode(each).alias("x")).select("x.*").groupBy("field", "value").agg(F.count("*").alias("n"))
