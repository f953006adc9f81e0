"""DuckDB SQL that gives the results of the queries that SQL can express."""

SQL = {}

SQL["p1_found"] = r"""
WITH b AS (SELECT url g, rec_id id, crawled_at t, editor, edition_date, nb_pages,
  trim(regexp_replace(strip_accents(lower(editor)), '[^\p{L}\p{N}/]+', ' ', 'g')) e, trim(edition_date) d,
  try_cast(regexp_extract(lower(trim(nb_pages)), '^(\d{1,9})\s*(?:pages?|pp?|pg)?\s*\.?$', 1) AS INT) p
  FROM babelio_book WHERE url IS NOT NULL),
l AS (SELECT notice g, id_livre id, maj_le t, try_cast(regexp_extract(annee, '^\D*(\d{4})\D*$', 1) AS INT) y FROM livre WHERE notice IS NOT NULL),
c AS (
  SELECT 'babelio_book' entity, g, 'editor' f, id, t FROM b WHERE regexp_matches(e, '\p{L}\p{L}')
    AND e NOT IN ('null','none','nan','na','n/a','nd','n d','sn','s n','sd','s d','nc','n c','sl','s l','unknown','anonyme','neant','vide','divers','xxx','xx','bientot','a paraitre','tbd','todo')
    AND NOT regexp_matches(e, '\b(inconnue?s?|unknown|non (renseigne|precise|disponible|communique|identifie|indique)e?s?|(sans|pas d) (editeur|nom|date|titre)|a (completer|venir|determiner|preciser))\b')
  UNION ALL
  SELECT 'babelio_book', g, 'edition_date', id, t FROM b WHERE
    (regexp_matches(d, '^\d{4}$') AND d > '0000' AND try_cast(d || '-01-01' AS TIMESTAMP) <= t)
    OR (regexp_matches(d, '^\d{2}/\d{4}$') AND right(d, 4) > '0000' AND try_cast(d[4:7] || '-' || d[1:2] || '-01' AS TIMESTAMP) <= t)
    OR (regexp_matches(d, '^\d{2}/\d{2}/\d{4}$') AND right(d, 4) > '0000' AND try_cast(d[7:10] || '-' || d[4:5] || '-' || d[1:2] AS TIMESTAMP) <= t)
  UNION ALL
  SELECT 'babelio_book', g, 'nb_pages', id, t FROM b WHERE p BETWEEN 1 AND 5000
  UNION ALL
  SELECT 'livre', g, 'annee', id, t FROM l WHERE y BETWEEN 1500 AND year(t)),
n AS (SELECT 'babelio_book' entity, g FROM b GROUP BY g HAVING count(*) > 1 UNION ALL SELECT 'livre', g FROM l GROUP BY g HAVING count(*) > 1)
SELECT entity, g AS group_key, f AS field_name, id AS rec_id FROM
 (SELECT c.*, row_number() OVER (PARTITION BY entity, g, f ORDER BY t DESC, id) r FROM c JOIN n USING (entity, g)) WHERE r = 1
"""


def _canonical() -> dict[str, str]:
    from catalink.llm.canonical import canonical_sql

    folded = rf"coalesce(regexp_extract_all(replace(replace(strip_accents(lower({canonical_sql('text')})), 'œ', 'oe'), 'æ', 'ae'), '[\p{{L}}\p{{N}}]+'), [])"
    return {
        "p9_canonical": f"SELECT doc_id, {canonical_sql('text')} canonical FROM documents",
        "p7_found": f"""
WITH d AS (SELECT doc_id, {folded} w FROM documents), i AS (SELECT item_id, {folded} w FROM eval_item),
dw AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) k FROM d WHERE len(w) >= 12)),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') x FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) k FROM i WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (x)""",
    }


SQL |= _canonical()

# By what may stand in a text, not by the form it is brought to.
SQL["p9_found"] = r"""
SELECT doc_id FROM documents WHERE text <> nfc_normalize(text)
  OR regexp_matches(text, '[\x{00A0}\x{00AD}\x{034F}\x{061C}\x{1680}\x{180B}-\x{180E}\x{2000}-\x{200F}\x{202A}-\x{202F}\x{205F}-\x{206F}\x{3000}\x{FE00}-\x{FE0F}\x{FEFF}]')
  OR regexp_matches(text, '[\x{FF01}-\x{FF5E}\x{FFE0}-\x{FFE6}\x{FF65}-\x{FFDC}\x{1D400}-\x{1D7FF}\x{2160}-\x{217F}\x{2100}\x{2102}\x{210A}-\x{2113}\x{2115}\x{2119}-\x{211D}\x{2124}\x{2128}\x{212A}-\x{212D}\x{212F}-\x{2134}\x{FB00}-\x{FB06}\x{017F}\x{0132}\x{0133}]')
  OR regexp_matches(text, '[\x{2010}\x{2011}\x{2212}\x{02D7}\x{2024}\x{2215}\x{02BC}\x{2217}\x{2223}\x{223C}\x{2236}\x{A789}\x{01C3}\x{FE50}-\x{FE6F}]')
  OR regexp_matches(text, '[\x{212E}\x{0131}\x{0251}\x{0261}\x{1D04}\x{1D0F}\x{1D20}\x{1D21}\x{1D22}\x{0184}]')
  OR regexp_matches(text, '\p{Latin}[\p{Cyrillic}\p{Greek}\p{Armenian}]|[\p{Cyrillic}\p{Greek}\p{Armenian}]\p{Latin}')
  OR len(list_filter(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+'), lambda w: regexp_full_match(w, '[аесіјорѕухԁһӏԛԝвнкмтАВЕКМНОРСТУХІЈЅҮΑΒΕΖΗΙΚΜΝΟΡΤΥΧο]+'))) > 0
"""

SQL["p3_found"] = """
WITH RECURSIVE p AS (SELECT nullif(author_db.author_key, '') a, nullif(author_wiki.author_key, '') b FROM couple_writers),
e AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT a, b FROM p UNION ALL SELECT b, a FROM p) WHERE a IS NOT NULL AND b IS NOT NULL),
cc(v, g) USING KEY (v) AS (
  SELECT v, v FROM (SELECT a v FROM p WHERE a IS NOT NULL UNION SELECT b FROM p WHERE b IS NOT NULL)
  UNION
  SELECT e.b, min(cc.g) FROM cc JOIN e ON e.a = cc.v JOIN recurring.cc u ON u.v = e.b WHERE cc.g < u.g GROUP BY e.b)
SELECT v AS author_key, g AS group_key FROM cc
"""


def _survivors(rounds: int = 15) -> str:
    """The rounds of truth discovery without prior, one table each; enough of them to come to rest."""
    head = SQL["p1_found"][: SQL["p1_found"].index("n AS (SELECT")].strip().rstrip(",")
    key = "entity, g, f"
    parts = [f"""{head},
v AS MATERIALIZED (SELECT c.entity, c.g, c.f, c.id, c.t, CASE c.f WHEN 'editor' THEN trim(regexp_replace(replace(replace(strip_accents(lower(b.editor)), 'œ', 'oe'), 'æ', 'ae'), '\\s+', ' ', 'g')) WHEN 'edition_date' THEN b.d WHEN 'nb_pages' THEN CAST(b.p AS VARCHAR) END val, coalesce(x.feed, '') source
  FROM c JOIN b ON c.id = b.id JOIN babelio_book x ON x.rec_id = c.id WHERE c.entity = 'babelio_book'
  UNION ALL SELECT c.entity, c.g, c.f, c.id, c.t, CAST(l.y AS VARCHAR), coalesce(x.source, '') FROM c JOIN l ON c.id = l.id JOIN livre x ON x.id_livre = c.id WHERE c.entity = 'livre'),
n AS (SELECT 'babelio_book' entity, g FROM b GROUP BY g HAVING count(*) > 1 UNION ALL SELECT 'livre', g FROM l GROUP BY g HAVING count(*) > 1),
u AS MATERIALIZED (SELECT v.*, count(*) OVER (PARTITION BY {key}) usable, row_number() OVER (PARTITION BY {key} ORDER BY t DESC, id) r, count(DISTINCT val) OVER (PARTITION BY {key}) vals FROM v JOIN n USING (entity, g)),
k AS MATERIALIZED (SELECT {key}, val, source, CASE WHEN r = 1 THEN 'newest' ELSE 'older' END age, CASE WHEN r = 1 THEN 1.0 ELSE least(usable - 1, 3) / (usable - 1) END voice, t, id FROM u WHERE vals > 1),
w0 AS MATERIALIZED (SELECT DISTINCT source, age, f, CAST(0.5 AS DOUBLE) wrong FROM k)"""]
    for i in range(rounds + 1):
        parts.append(f"""s{i} AS MATERIALIZED (SELECT {key}, val, sum(voice * -ln(wrong)) vote, max(t) t, arg_min(id, (epoch_us(t) * -1, id)) id FROM k JOIN w{i} USING (source, age, f) GROUP BY ALL),
t{i} AS MATERIALIZED (SELECT {key}, val AS truth, vote / total AS support FROM (SELECT *, sum(vote) OVER (PARTITION BY {key}) total, row_number() OVER (PARTITION BY {key} ORDER BY round(vote, 9) DESC, t DESC, id, val DESC) r FROM s{i}) WHERE r = 1),
w{i + 1} AS MATERIALIZED (SELECT source, age, f, (sum(CASE WHEN val <> truth THEN voice ELSE 0 END) + 1) / (sum(voice) + 2) wrong FROM k JOIN t{i} USING ({key}) GROUP BY ALL)""")
    last = f"""SELECT entity, g AS group_key, max(val) FILTER (f = 'editor') editor, max(val) FILTER (f = 'edition_date') edition_date, max(val) FILTER (f = 'nb_pages') nb_pages, max(val) FILTER (f = 'annee') annee
FROM (SELECT {key}, truth AS val FROM t{rounds} UNION ALL SELECT {key}, max(val) FROM u WHERE vals = 1 GROUP BY ALL) GROUP BY 1, 2"""
    return ",\n".join(parts) + "\n" + last


SQL["p1_survivors"] = _survivors()
