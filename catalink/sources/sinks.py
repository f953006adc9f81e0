"""Writers of the catalogue's output formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(rows: DataFrame, path: str, sep: str = " ; ", mode: str = "errorifexists") -> None:
    """One line per row, values joined by sep; nulls are empty."""
    rows.select(F.concat_ws(sep, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns]).alias("value")).write.mode(mode).text(path)


def table(rows: DataFrame, path: str, sep: str = ",", header: bool = True, mode: str = "errorifexists", encoding: str = "UTF-8") -> None:
    """A delimited file; lists and structs are written as JSON, characters an encoding lacks as question marks."""
    flat = [F.to_json(f"`{f.name}`").alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f"`{f.name}`") for f in rows.schema.fields]
    rows.select(*flat).write.mode(mode).csv(path, sep=sep, header=header, escape='"', encoding=encoding, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def sorted_table(rows: DataFrame, path: str, by: str, sep: str = "|") -> None:
    """A delimited file in order of a column."""
    rows.orderBy(by).write.csv(path, sep=sep, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def json(rows: DataFrame, path: str) -> None:
    """One object a line."""
    rows.write.json(path)


def json_array(rows: DataFrame, path: str) -> None:
    """Files of one JSON array each, written as they come: an object a line between brackets; tasks without rows write none."""
    import pandas as pd

    def run(batches):  # noqa: ANN001, ANN202
        held = None
        for batch in batches:
            out = []
            for x in batch["value"]:
                if held is not None:
                    out.append(held + ",")
                held = x if held is not None else "[" + x
            yield pd.DataFrame({"value": out})
        if held is not None:
            yield pd.DataFrame({"value": [held + "]"]})

    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).mapInPandas(run, "value string").write.text(path)


def statistics(rows: DataFrame, path: str) -> None:
    """A small table of counts as indented JSON, one object a line group."""
    rows.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).write.text(path, lineSep="\n\n")


def n_triples(triples: DataFrame, path: str) -> None:
    from catalink.operators.graph import n_triples as as_lines

    as_lines(triples).write.text(path)


def rdf_xml(triples: DataFrame, path: str) -> None:
    """RDF/XML files: one rdf:Description for each subject and task-sized part of its triples, namespaces declared where used.

    triples has s, p, o and perhaps o_kind, o_datatype, o_lang. Parts of one subject are written as elements of
    their own, which says the same, so a subject with most of the triples is no burden.
    """
    have = set(triples.columns)
    none = F.lit(None).cast("string")
    rows = triples.select("s", "p", "o", *[(F.col(c) if c in have else none).alias(c) for c in ("o_kind", "o_datatype", "o_lang")]).distinct()

    def run(batches):  # noqa: ANN001, ANN202
        import re
        from xml.sax.saxutils import escape, quoteattr

        import pandas as pd

        bad = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
        started = False
        for batch in batches:
            out = [] if started else ['<?xml version="1.0" encoding="UTF-8"?>', '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">']
            started = True
            subject = None
            for s, p, o, kind, datatype, lang in batch[["s", "p", "o", "o_kind", "o_datatype", "o_lang"]].itertuples(index=False):
                if s != subject:
                    if subject is not None:
                        out.append("</rdf:Description>")
                    subject = s
                    out.append(f"<rdf:Description rdf:nodeID={quoteattr(s[2:])}>" if s.startswith("_:") else f"<rdf:Description rdf:about={quoteattr(s)}>")
                m = re.fullmatch(r"(.*[/#:])([^/#:]+)", p)
                base, name = m.groups() if m else ("", p)
                tag = f'ns:{name} xmlns:ns={quoteattr(base)}'
                if kind == "uri":
                    out.append(f"<{tag} rdf:resource={quoteattr(o)}/>")
                elif kind == "blank":
                    out.append(f"<{tag} rdf:nodeID={quoteattr(o[2:])}/>")
                else:
                    more = f" xml:lang={quoteattr(lang)}" if lang else f" rdf:datatype={quoteattr(datatype)}" if datatype else ""
                    text = escape(bad.sub("", o)).replace("\r", "&#13;").replace("\n", "&#10;")
                    out.append(f"<{tag}{more}>{text}</ns:{name}>")
            if subject is not None:
                out.append("</rdf:Description>")
            yield pd.DataFrame({"value": out})
        if started:
            yield pd.DataFrame({"value": ["</rdf:RDF>"]})

    rows.sortWithinPartitions("s").mapInPandas(run, "value string").write.text(path)


def vectors(rows: DataFrame, path: str, token: str = "token", vector: str = "vector", places: int = 6) -> None:
    """A text file of embeddings, numbers rounded."""
    rows.select(F.concat_ws(" ", token, F.array_join(F.transform(vector, lambda x: F.round(x, places).cast("string")), " ")).alias("value")).write.text(path)


def convert(rows: DataFrame, path: str, escaped: tuple[str, ...] = ()) -> None:
    """Rows appended to a comma-separated file; in the columns named in escaped commas get a backslash in front."""
    rows.withColumns({c: F.replace(F.col(c), F.lit(","), F.lit("\\,")) for c in escaped}).write.mode("append").csv(path, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
