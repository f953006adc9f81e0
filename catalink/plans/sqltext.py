"""DuckDB expressions for the text functions, spelled out from the same fixed values."""

from __future__ import annotations

from catalink.functions import text


#: Brackets of the tables are nested less deep than this.
DEPTH = 8


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def fixed(c: str, variant: str = "core") -> str:
    for bad, good in text.MOJIBAKE_CORE if variant == "core" else text.MOJIBAKE_ALIGNMENT:
        c = f"replace({c}, {quote(bad)}, {quote(good)})"
    return c


def bare(c: str) -> str:
    return f"replace(replace(translate({c}, {quote(text.ACCENTS_FROM)}, {quote(text.ACCENTS_TO)}), 'œ', 'oe'), '\"', '')"


def no_parens(c: str) -> str:
    for _ in range(DEPTH):
        c = f"regexp_replace({c}, '\\([^()]*\\)', '', 'g')"
    return c


def normal(c: str) -> str:
    inner = no_parens(bare(fixed(c)))
    return rf"lower(trim(regexp_replace(regexp_replace({inner}, '[^\p{{L}}\p{{M}}\p{{Nd}}_\p{{Z}}\s\x{{85}}\-]', ' ', 'g'), '[\p{{Z}}\s\x{{85}}]+', ' ', 'g')))"


def author(c: str) -> str:
    w = r"[\p{L}\p{M}\p{Nd}_]"
    return rf"regexp_replace({normal(c)}, '^{w}\s|\s{w}\s|\s{w}$', '', 'g')"


def isbn(c: str) -> str:
    kept = f"regexp_replace({no_parens(c)}, '[^0-9X]', '', 'g')"
    ten = f"CASE WHEN length({kept}) = 10 THEN '978' || {kept} ELSE {kept} END"
    return f"CASE WHEN length({ten}) = 12 THEN ({ten}) || '#' ELSE {ten} END"


def isbn_key(c: str) -> str:
    d = f"regexp_replace({c}, '[^0-9]', '', 'g')"
    a = f"(CASE WHEN length({d}) IN (9, 12) THEN {d} || 'X' ELSE {d} END)"
    b = f"(CASE WHEN length({a}) = 10 THEN '978' || {a} ELSE {a} END)"
    return f"left({b}, greatest(length({b}) - 1, 0)) || 'X'"


#: Signs that stand in no normalised text, one byte each.
_SPARE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!\"#$%&()*+,./:;<=>?@[]^`{|}~" + "".join(map(chr, range(1, 32)))


def odd_signs(tables: str) -> str:
    """A table `odd` with one text of all characters beyond ASCII of the texts t that a query gives."""
    return rf"odd AS MATERIALIZED (SELECT coalesce(string_agg(c, '' ORDER BY c), '') cs FROM (SELECT DISTINCT unnest(regexp_extract_all(t, '[^\x00-\x7F]')) c FROM ({tables})))"


def one_byte(c: str) -> str:
    """A text with each character beyond ASCII exchanged one to one for a spare sign: levenshtein() counts bytes."""
    return f"translate({c}, (SELECT cs FROM odd), {quote(_SPARE)})"


def swapped(c: str) -> str:
    return f"CASE WHEN len(string_split({c}, ',')) > 1 THEN trim(string_split({c}, ',')[2]) || ' ' || trim(string_split({c}, ',')[1]) ELSE trim({c}) END"


#: Book records of all sources: uid, id, data_base, title, authors, isbns and raw lists.
BOOKS = f"""
raw AS (
  SELECT CAST(id_livre AS VARCHAR) id, source data_base, titre t, coalesce(auteurs, []) a, coalesce(isbn, []) i FROM livre
  UNION ALL
  SELECT CAST(rec_id AS VARCHAR), 'babelio', title, coalesce(list_transform(author, lambda x: {swapped('x')}), []), CASE WHEN ean IS NULL THEN [] ELSE [ean] END FROM babelio_book),
books AS (
  SELECT coalesce(data_base || '|', '') || id uid, id, data_base, {normal('t')} title, t title_raw, a authors_raw, i isbns_raw,
    list_filter(list_transform(a, lambda x: {author('x')}), lambda x: x <> '') authors,
    list_filter(list_transform(i, lambda x: {isbn('x')}), lambda x: x <> '') isbns
  FROM raw)
"""

#: Titles of each source by alignment key, then one row per key.
ALIGNED = f"""
keyed AS (
  SELECT {isbn_key('r')} isbn, data_base, max(title) title FROM
    (SELECT data_base, {fixed('title_raw', 'alignment')} title, unnest(CASE WHEN len(isbns_raw) > 0 THEN list_transform(isbns_raw, lambda x: {no_parens('x')}) ELSE [''] END) r FROM books)
  GROUP BY 1, 2),
aligned AS (
  SELECT isbn, max(title) FILTER (data_base = 'adp') adp, max(title) FILTER (data_base = 'ile') ile, max(title) FILTER (data_base = 'depot') depot,
    max(title) FILTER (data_base = 'hurtubise') hurtubise, max(title) FILTER (data_base = 'babelio') babelio FROM keyed GROUP BY 1),
counted AS (
  SELECT *, (adp IS NOT NULL)::INT + (ile IS NOT NULL)::INT + (depot IS NOT NULL)::INT + (hurtubise IS NOT NULL)::INT + (babelio IS NOT NULL)::INT n_sources FROM aligned)
"""
