"""Text functions of the catalogue as column expressions: cleaning, normalising, extracting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, applied in this order: UTF-8 that was read as Latin-1 (variant "core").
MOJIBAKE_CORE = (
    ("Ã\xa0", "à"), ("Ã€", "À"), ("Ã¢", "â"), ("Ã‚", "Â"), ("Ã©", "é"), ("Ã\x89", "É"), ("Ã\xa8", "è"), ("Ã\xaa", "ê"), ("Ã\x8a", "Ê"),
    ("Ã«", "ë"), ("Ã®", "î"), ("Ã\x8e", "Î"), ("Ã¯", "ï"), ("Ã´", "ô"), ("Ã\x94", "Ô"), ("Ã¹", "ù"), ("Ã»", "û"), ("Å\x93", "œ"),
    ("Â«", "«"), ("Â»", "»"), ("Ã§", "ç"), ("Ã\x87", "Ç"), ("Âº", "º"), ("â\x80\x99", "’"), ("â\x80\xa6", "…"),
)

# Fixed values, applied in this order: the longer list used for alignment (variant "alignment"), in which è becomes ê.
MOJIBAKE_ALIGNMENT = (
    ("Ã\xa0", "à"), ("Ã€", "À"), ("Ã¢", "â"), ("ã", "â"), ("Ã‚", "Â"), ("Ã©", "é"), ("ã‰", "é"), ("ãƒâ©", "é"), ("Ã\x89", "É"), ("Ã\xa8", "ê"),
    ("Ã\xaa", "ê"), ("Ã\x8a", "Ê"), ("Ã«", "ë"), ("Ã®", "î"), ("Ã\x8e", "Î"), ("Ã¯", "ï"), ("Ã´", "ô"), ("Ã\x94", "Ô"), ("Ã¹", "ù"),
    ("Ã»", "û"), ("Å\x93", "œ"), ("Â«", "«"), ("Â»", "»"), ("Ã§", "ç"), ("Ã\x87", "Ç"), ("Âº", "º"), ("â€™", "’"), ("â\x80\x99", "’"), ("â\x80\xa6", "…"),
)

# Letters and what they become.
ACCENTS_FROM = "ãÃâÂàÀäÄéÉèÈêÊïÏîÎôÔöÖùÙüÜûÛÿŸç'"
ACCENTS_TO = "aAaAaAaAeEeEeEiIiIoOoOuUuUuUyyc "

def fix_mojibake(c: Column, variant: str = "core") -> Column:
    """Undo UTF-8 read as Latin-1 by the ordered replacements of a variant; null stays null."""
    for bad, good in MOJIBAKE_CORE if variant == "core" else MOJIBAKE_ALIGNMENT:
        c = F.replace(c, F.lit(bad), F.lit(good))
    return c


def strip_accents_fr(c: Column) -> Column:
    """French letters without accents; the apostrophe becomes a blank, the quotation mark goes, Œ and Ç stay."""
    return F.replace(F.replace(F.translate(c, ACCENTS_FROM, ACCENTS_TO), F.lit("œ"), F.lit("oe")), F.lit('"'), F.lit(""))


_GROUP = r"\([^()]*\)"


def _levels(c: Column) -> Column:
    """As many elements as brackets are opened: no text is nested deeper."""
    return F.array_repeat(F.lit(0), F.regexp_count(c, F.lit(r"\(")))


def strip_parens(c: Column) -> Column:
    """Without what stands in balanced brackets, however deep they are nested; unbalanced brackets stay."""
    return F.get(F.transform(F.array(c), lambda x: F.aggregate(_levels(x), x, lambda t, _: F.regexp_replace(t, _GROUP, ""))), 0)


def text_in_parens(c: Column, first_only: bool = False) -> Column:
    """The bracketed groups of a text, innermost first; with first_only one group of each pass, as counted once."""
    if not first_only:
        return F.regexp_extract_all(c, F.lit(_GROUP), F.lit(0))
    start = lambda x: F.struct(x.alias("t"), F.array().cast("array<string>").alias("found"))
    step = lambda s, _: F.struct(F.regexp_replace(s.t, _GROUP, "").alias("t"), F.concat(s.found, F.array(F.regexp_extract(s.t, _GROUP, 0))).alias("found"))
    return F.get(F.transform(F.array(c), lambda x: F.filter(F.aggregate(_levels(x), start(x), step).found, lambda g: g != "")), 0)


def _blanks(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize(c: Column) -> Column:
    """Comparison form: mojibake, accents and brackets gone, other signs than - and _ blank, lower case."""
    plain = strip_parens(strip_accents_fr(fix_mojibake(c)))
    return F.lower(_blanks(F.regexp_replace(plain, r"(?U)[^\w\s\-]", " ")))


def normalize_alignment(c: Column) -> Column:
    """Form for alignment: outer signs gone, inner signs blank, runs of blanks one; case and accents stay."""
    trimmed = F.regexp_replace(c, r"(?U)^\W+|\W+$", "")
    return F.replace(F.regexp_replace(F.regexp_replace(trimmed, r"(?U)\W", " "), " +", " "), F.lit(","), F.lit(""))


def normalize_author(c: Column) -> Column:
    """normalize() without single letters; blanks around them go too, so neighbours join."""
    return F.regexp_replace(normalize(c), r"(?U)^\w\s|\s\w\s|\s\w$", "")


def normalize_isbn(c: Column) -> Column:
    """Digits and X without brackets; 10 get 978 in front, 12 are padded with #."""
    kept = F.regexp_replace(strip_parens(c), r"[^\dX]", "")
    longer = F.when(F.length(kept) == 10, F.concat(F.lit("978"), kept)).otherwise(kept)
    return F.when(F.length(longer) == 12, F.rpad(longer, 13, "#")).otherwise(longer)


def format_isbn(c: Column) -> Column:
    """Alignment key: digits, 978 in front of ten, the last place always X; the empty text gives X."""
    kept = F.regexp_replace(c, r"\D", "")
    kept = F.when(F.length(kept).isin(9, 12), F.concat(kept, F.lit("X"))).otherwise(kept)
    kept = F.when(F.length(kept) == 10, F.concat(F.lit("978"), kept)).otherwise(kept)
    return F.concat(F.substring(kept, F.lit(1), F.greatest(F.length(kept) - 1, F.lit(0))), F.lit("X"))


def split_isbns(c: Column) -> Column:
    """Several ISBNs of one field, parted by bar, semicolon or comma; blanks and empties go."""
    return F.filter(F.transform(F.split(c, r"[|;,]"), lambda x: F.trim(x)), lambda x: x != "")


def split_list(c: Column, sep: str = ",") -> Column:
    """Parts of a list without outer blanks and empties; null gives an empty list."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), re.escape(sep)), lambda x: F.trim(x)), lambda x: x != "")


def main_title(c: Column) -> Column:
    """Before the first ' / ', then before the first ' : '."""
    return F.split_part(F.split_part(c, F.lit(" / "), F.lit(1)), F.lit(" : "), F.lit(1))


def last_part(c: Column, sep: str = " / ") -> Column:
    return F.element_at(F.split(c, re.escape(sep)), -1)


def before_paren(c: Column) -> Column:
    """A label without its qualifier in brackets."""
    return F.split_part(c, F.lit(" ("), F.lit(1))


def with_birth_year(name: Column, year: Column) -> Column:
    return F.concat_ws(" ", name, year)


def swap_name(c: Column, sep: str = ",") -> Column:
    """'Family, Given' as 'Given Family'; a name without separator stays."""
    parts = F.transform(F.split(c, re.escape(sep)), lambda x: F.trim(x))
    return F.when(F.size(parts) > 1, F.concat_ws(" ", F.get(parts, 1), F.get(parts, 0))).otherwise(F.trim(c))


def with_types(schema, f):  # noqa: ANN001, ANN201
    """A function from column to column that applies f to every text within a value of some type."""
    from pyspark.sql import types as T

    if isinstance(schema, T.StringType):
        return f
    if isinstance(schema, T.ArrayType):
        inner = with_types(schema.elementType, f)
        return (lambda c: F.transform(c, inner)) if inner else None
    if isinstance(schema, T.StructType):
        inner = {x.name: with_types(x.dataType, f) for x in schema.fields}
        if any(inner.values()):
            return lambda c: F.when(c.isNotNull(), F.struct(*[(inner[n](c[n]) if inner[n] else c[n]).alias(n) for n in schema.fieldNames()]))
    return None


def clean_items(rows, columns: list[str] | None = None):  # noqa: ANN001, ANN201
    """Rows in which every text, however deep, is without tabs and line ends."""
    made = {x.name: with_types(x.dataType, clean_blanks) for x in rows.schema.fields if columns is None or x.name in columns}
    return rows.withColumns({n: f(F.col(n)) for n, f in made.items() if f})


def renamed(rows, names: dict[str, str]):  # noqa: ANN001, ANN201
    """Rows with fields renamed by a dictionary, also within lists and records."""
    from pyspark.sql import types as T

    def of(t: T.DataType) -> T.DataType:
        if isinstance(t, T.ArrayType):
            return T.ArrayType(of(t.elementType), t.containsNull)
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(names.get(f.name, f.name), of(f.dataType), f.nullable) for f in t.fields])
        return t

    return rows.select(*[F.col(f"`{f.name}`").cast(of(f.dataType)).alias(names.get(f.name, f.name)) for f in rows.schema.fields])


def merged(a: Column, b: Column) -> Column:
    """Two maps as one; where both have a key, the second one's value stands."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x))


def label_replace(c: Column, pattern: str, to: str) -> Column:
    """All matches of a pattern replaced, as a query endpoint's REPLACE does."""
    return F.regexp_replace(c, pattern, to)


def family_name(c: Column) -> Column:
    return F.trim(F.get(F.split(c, ","), 0))


def given_name(c: Column) -> Column:
    return F.trim(F.coalesce(F.get(F.split(c, ","), 1), F.lit("")))


def uri_tail(c: Column) -> Column:
    """Last path part that is not empty."""
    return F.element_at(F.filter(F.split(c, "/"), lambda x: x != ""), -1)


def title_case(c: Column) -> Column:
    """Words with only their first letters as written, the rest lower; parts at hyphens, else at apostrophes, count as words."""
    low = lambda w: F.concat(F.substring(w, 1, 1), F.lower(F.substring(w, F.lit(2), F.length(w))))
    parts = lambda w, sep: F.array_join(F.transform(F.split(w, sep), low), sep)
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(w.contains("-"), parts(w, "-")).when(w.contains("'"), parts(w, "'")).otherwise(low(w))), " ")


# Roles of contributors and the property of each, in the order in which they are looked for.
ROLES = (
    ("(De (auteur))", "http://schema.org/author"),
    ("(Coordination éditoriale de)", "http://schema.org/editor"),
    ("(Photographies de)", "https://distributionhmh.com/onto/photographiesDe"),
    ("(Postface de)", "https://distributionhmh.com/onto/postfaceDe"),
    ("(Préface de)", "https://distributionhmh.com/onto/PrefaceDe"),
    ("(De (photographe))", "http://schema.org/author"),
    ("(Traduit par)", "http://schema.org/translator"),
    ("(Avant-propos de)", "https://distributionhmh.com/onto/avantProposDe"),
    ("(Illustré par)", "http://schema.org/illustrator"),
    ("(Texte de)", "https://distributionhmh.com/onto/texteDe"),
    ("(Adapté par)", "https://distributionhmh.com/onto/adaptePar"),
)


def _role_at(c: Column) -> Column:
    return F.coalesce(*[F.when(F.instr(F.trim(c), r) > 0, F.instr(F.trim(c), r)) for r, _ in ROLES])


def contributor_name(c: Column) -> Column:
    """The name before the first known role; without role the empty text."""
    return F.coalesce(F.substring(F.trim(c), F.lit(1), F.greatest(_role_at(c) - 2, F.lit(0))), F.lit(""))


def contributor_role(c: Column) -> Column:
    """From the first known role on; without role the empty text."""
    return F.coalesce(F.substring(F.trim(c), _role_at(c), F.length(c)), F.lit(""))


def role_property(role: Column) -> Column:
    """The property of a role, or null."""
    pairs = [F.lit(x) for r in ROLES for x in r]
    return F.try_element_at(F.create_map(*pairs), role)


# Language names and their codes; subject codes of literary genres.
LANGUAGES = {"Allemand": "de", "Anglais": "en", "Arabe": "ar", "Brésilien": "pt-BR", "Espagnol": "es", "Français": "fr", "Italien": "it", "Latin": "la", "Portugais": "pt"}
GENRES = {"16.32": "Poésie", "16.33": "Théatre", "16.34": "Roman", "16.35": "Contes/Nouvelles", "16.38": "Jeunesse", "16.41": "Bandes dessinées"}

# The codes of product descriptions and their meaning, by list.
ONIX_CODES = {
    "product identifier": {"01": "Proprietary", "02": "ISBN-10", "03": "GTIN-13", "06": "DOI", "13": "LCCN", "15": "ISBN-15"},
    "product form": {"00": "Undefined", "BA": "Book", "BB": "Hardback", "BC": "Paperback / softback"},
    "title level": {"01": "Product", "02": "Collection level", "03": "Subcollection"},
    "contributor role": {"A01": "By (author)", "A02": "With"},
    "language role": {"01": "Language of text", "02": "Original language of a translated text"},
    "subject scheme": {"01": "Dewey", "10": "BISAC", "23": "Publisher's own category", "93": "Thema", "94": "Thema place qualifier"},
    "publishing role": {"01": "Publisher", "10": "Publishing group"},
    "text type": {"03": "Description", "06": "Review quote", "10": "Promotional headline"},
}


def lookup(c: Column, table: dict[str, str]) -> Column:
    """The value of a constant table, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def genre(subject: Column) -> Column:
    """Genre by the first five places of a subject, or null."""
    return lookup(F.substring(subject, 1, 5), GENRES)


# Patterns of fields within the free text of book and author pages.
INFO_PATTERNS = {
    "edition_date": r"\((\d{0,2}/?\d{0,2}/?\d{4})\)",
    "ean": r"EAN[ :]+([\d-]+)",
    "nb_pages": r"[ ]*([\d]+) pages",
    "nationnality": r"Nationalité[ :]+?([ \S]+?) Né",
    "place_of_birth": r"Né\(e\)[à :]+?([ \S]+?)[\(,]",
    "country_of_birth": r"Né\(e\)[à :]+?[ \S]+? \(([ \S]+?)\)",
    "date_of_birth": r"Né\(e\)[à :]+?[ \(\)\S]+?le[ ]+?(\d{0,2}/?\d{0,2}/?\d{4})",
    "place_of_death": r"Mort\(e\)[à :]+?([ \S]+?)[\(,]",
    "country_of_death": r"Mort\(e\)[à :]+?[ \S]+?\(([ \S]+?)\)",
    "date_of_death": r"Mort\(e\)[à :]+?[ \(\)\S]+?le[ ]+?(\d{0,2}/?\d{0,2}/?\d{4})",
    "importance": r"tag_t([\d]+) ",
}


def info_field(c: Column, name: str) -> Column:
    """A field out of the free text of a page, or null where the pattern is not met."""
    return F.nullif(F.regexp_extract(c, INFO_PATTERNS[name], 1), F.lit(""))


def clean_blanks(c: Column) -> Column:
    """Runs of tabs become a blank, line ends go."""
    return F.replace(F.regexp_replace(c, "\t+", " "), F.lit("\n"), F.lit(""))


def work_info(lines: Column) -> dict[str, Column]:
    """Title, year, place, publisher and ISBN of a work from the lines of its notice (an array)."""
    head = F.get(lines, 0)
    year = F.regexp_extract(head, r" \([0-9,\-|]+\)", 0)
    edition = F.get(F.filter(lines, lambda x: x.startswith(", ")), 0)
    told = F.substring(edition, F.lit(3), F.length(edition))
    split = F.split(told, ":")
    isbn = F.get(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x.startswith("ISBN :")), 0)
    return {
        "title": F.when(year != "", F.replace(head, year, F.lit(""))).otherwise(head),
        "year": F.nullif(F.regexp_replace(year, r"^ \(|\)$", ""), F.lit("")),
        "place": F.when(F.size(split) > 1, F.trim(F.get(split, 0))),
        "publisher": F.when(F.size(split) > 1, F.trim(F.get(split, 1))).otherwise(F.trim(told)),
        "isbn": F.substring(isbn, F.lit(8), F.length(isbn)),
    }


def bio_text(c: Column) -> Column:
    """Without the heading of a notice."""
    return F.regexp_replace(c, r"^Notice biographique\n", "")


def bare_place(c: Column) -> Column:
    """Without square brackets around all of it."""
    return F.when(F.trim(c).rlike(r"^\[.+\]$"), F.regexp_replace(F.trim(c), r"^\[|\]$", "")).otherwise(F.trim(c))


def isbn_path(c: Column) -> Column:
    """A code cut in places 4/3/3/rest, as in the paths of a product store."""
    return F.concat_ws("/", F.substring(c, 1, 4), F.substring(c, 5, 3), F.substring(c, 8, 3), F.substring(c, F.lit(11), F.length(c)))


def show_record(**fields: Column) -> Column:
    """A readable line of a record: valid or not, title, and the sizes of its lists."""
    ok = F.when((F.coalesce(fields["title"], F.lit("")) != "") | (F.coalesce(fields["id"], F.lit("")) != ""), F.lit("valid")).otherwise(F.lit("invalid"))
    return F.format_string("%s book %s [%s]: %d authors, %d isbns", ok, F.coalesce(fields["title"], F.lit("")), F.coalesce(fields["data_base"], F.lit("")), F.size(fields["authors"]), F.size(fields["isbns"]))
