"""Visually identical text: one consistent form, computed by DuckDB inside Arrow partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that are drawn with no width.
INVISIBLE = (
    r"\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}"
    r"\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{0000}-\x{0008}\x{000E}-\x{001F}"
    r"\x{007F}\x{E0001}\x{E0020}-\x{E007F}"
)

# Spaces other than U+0020 (line ends and tabs stay).
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

# Signs drawn like an ASCII sign. Typographic quotes and dashes are not among them.
SIGNS = {
    "‐": "-", "‑": "-", "−": "-", "﹣": "-", "˗": "-",
    "․": ".", "﹒": ".", "﹐": ",", "﹔": ";", "﹕": ":", "∶": ":", "꞉": ":",
    "﹖": "?", "﹗": "!", "ǃ": "!", "∕": "/", "ʼ": "'", "｡": "。",
    "٪": "%", "∗": "*", "∣": "|", "∼": "~", "﹙": "(", "﹚": ")", "﹟": "#",
    "﹠": "&", "﹡": "*", "﹢": "+", "﹤": "<", "﹥": ">", "﹦": "=", "﹩": "$",
    "﹪": "%", "﹫": "@",
}

# Presentation ligatures and the long s.
LIGATURES = {
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
    "ſ": "s", "Ĳ": "IJ", "ĳ": "ij", "Ǉ": "LJ", "ǉ": "lj", "Ǌ": "NJ", "ǌ": "nj",
}

# Letters of other scripts drawn like a Latin one, by the Latin letter.
TWINS = {
    "a": "аɑα", "b": "Ƅ", "c": "сϲᴄ", "d": "ԁ", "e": "е℮", "g": "ɡց",
    "h": "һհ", "i": "іιı", "j": "јϳ", "k": "κ", "l": "ӏ", "n": "ո",
    "o": "оοօᴏ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "u": "υս",
    "v": "νѵᴠ", "w": "ԝѡᴡ", "x": "хχ", "y": "уγү", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "G": "Ԍ", "H": "НΗ",
    "I": "ІΙӀ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟՕ",
    "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "U": "Ս", "V": "Ѵ", "W": "Ԝ",
    "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    "é": "ӗ", "è": "ѐ", "ë": "ё", "ï": "ї", "È": "Ѐ", "Ë": "Ё", "Ï": "Ї",
}

# Of these the likeness is loose: they count inside a word that also has Latin letters, not in a word by itself.
LOOSE = "αικυгγɑρχν"


# Characters that are consistent whatever stands beside them; a text of these alone is returned at once.
PLAIN = r"\x{0009}\x{000A}\x{000D}\x{0020}-\x{007E}\x{00A1}-\x{00AC}\x{00AE}-\x{00FF}\x{0152}\x{0153}\x{2013}\x{2014}\x{2018}-\x{201E}\x{2026}\x{20AC}"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _tables() -> tuple[str, str, str, str, str, list[tuple[str, str]]]:
    """Code points and targets for translate(), the look-alikes, and replacements of several letters."""
    import unicodedata

    pairs = {s: " " for s in SPACES} | dict(SIGNS)
    several = dict(LIGATURES)
    # Wide, narrow, styled and numeral forms: Unicode's own compatibility mappings say what they read as.
    for first, last in ((0xFF01, 0xFF5E), (0xFFE0, 0xFFE6), (0xFF65, 0xFFDC), (0x2160, 0x217F), (0x1D400, 0x1D7FF), (0x2100, 0x214F)):
        for point in range(first, last + 1):
            ch = chr(point)
            kind = unicodedata.decomposition(ch).partition(" ")[0]
            to = unicodedata.normalize("NFKC", ch)
            if ch in INVISIBLE or to == ch or kind not in ("<wide>", "<narrow>", "<font>", "<compat>"):
                continue
            if kind == "<compat>" and not 0x2160 <= point <= 0x217F:
                continue
            if len(to) == 1:
                pairs[ch] = to
            else:
                several[ch] = to
    twins = {x: latin for latin, many in TWINS.items() for x in many}
    return "".join(pairs), "".join(pairs.values()), "".join(twins), "".join(twins.values()), "".join(x for x in twins if x not in LOOSE), list(several.items())


def canonical_sql(column: str) -> str:
    """The SQL expression that brings a text column to its consistent form.

    Order: invisible characters go, wide/narrow/styled forms, spaces and signs are translated, accents are
    composed, then look-alike letters are exchanged word by word: in words that also have Latin letters, or
    that consist of nothing but close look-alikes. Words wholly of another script stay.
    """
    froms, tos, twins, latin, close, several = _tables()
    composed = f"nfc_normalize(regexp_replace({column}, '[{INVISIBLE}]', '', 'g'))"
    simple = f"translate({composed}, {_lit(froms)}, {_lit(tos)})"
    for a, b in several:
        if ord(a) >= 0xFB00 or ord(a) < 0x0200 or 0x2160 <= ord(a) <= 0x217F:
            simple = f"replace({simple}, {_lit(a)}, {_lit(b)})"
    simple = f"nfc_normalize({simple})"
    word = r"[\p{L}\p{M}\p{N}]+"
    return f"""
    CASE WHEN {column} IS NULL THEN NULL
         WHEN regexp_full_match({column}, '[{PLAIN}]*') THEN {column}
         ELSE list_aggregate(list_transform([{simple}], lambda s:
            CASE WHEN NOT regexp_matches(s, '[{twins}]') THEN s
                 ELSE nfc_normalize(array_to_string(list_transform(
                    regexp_extract_all(s, '{word}|[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w:
                      CASE WHEN regexp_matches(w, '[{twins}]')
                                AND (regexp_matches(w, '\\p{{Latin}}') OR regexp_full_match(w, '[{close}]+'))
                           THEN translate(w, {_lit(twins)}, {_lit(latin)}) ELSE w END), '')) END), 'any_value') END
    """


def _in_duckdb(df: DataFrame, text: str, out: str, keep: list[str] | None, sql: str, kind: T.DataType, arrow: pa.DataType) -> DataFrame:
    """Columns in keep and the value of a DuckDB expression over column __text, batch by batch."""
    names = [c for c in (df.columns if keep is None else keep) if c != out]
    wanted = df.select(*[df[f"`{c}`"] for c in names], df[f"`{text}`"].cast("string").alias("__text"))
    schema = T.StructType([wanted.schema[c] for c in names] + [T.StructField(out, kind)])
    query = f"SELECT {sql} AS v FROM batch ORDER BY i"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        try:
            for one in batches:
                con.register("batch", pa.table({"i": pa.array(range(one.num_rows), pa.int64()), "__text": one.column(one.num_columns - 1)}))
                made = con.sql(query).to_arrow_table().column("v")
                con.unregister("batch")
                made = made.cast(arrow).combine_chunks()
                if isinstance(made, pa.ChunkedArray):
                    made = pa.concat_arrays(made.chunks) if made.num_chunks else pa.array([], arrow)
                yield pa.RecordBatch.from_arrays([one.column(i) for i in range(one.num_columns - 1)] + [made], names=[*names, out])
        finally:
            con.close()

    return wanted.mapInArrow(run, schema)


def canonical_text(df: DataFrame, text: str = "text", out: str = "canonical", keep: list[str] | None = None) -> DataFrame:
    """The columns named in keep (default: all) and the consistent form of a text column.

    A null text gives null, an empty one an empty one; nothing but text decides the result, so repeated rows
    give repeated results and extra columns pass through untouched. A column that already has the name in out
    is replaced. Texts are never cut. One DuckDB connection per task, one thread, batches as Spark hands them.
    """
    return _in_duckdb(df, text, out, keep, canonical_sql("__text"), T.StringType(), pa.string())


def folded_words(df: DataFrame, text: str = "text", out: str = "words", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep and the words of the consistent form, without case and accents (oe for the ligature).

    A word is a longest run of letters and digits. A null or empty text gives an empty list.
    """
    sql = (
        f"coalesce(regexp_extract_all(replace(replace(strip_accents(lower({canonical_sql('__text')})), "
        "'\u0153', 'oe'), '\u00e6', 'ae'), '[\\p{L}\\p{N}]+'), [])"
    )
    return _in_duckdb(df, text, out, keep, sql, T.ArrayType(T.StringType()), pa.list_(pa.string()))


def not_canonical(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keys of the rows whose text is not in its consistent form."""
    slim = df.select(F.col(key), F.col(text).alias("__raw"))
    return canonical_text(slim, "__raw", "__same").where("__raw <> __same").select(key)
