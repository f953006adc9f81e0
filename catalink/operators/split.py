"""Several values packed in one field: delimiters inferred per source, one row per value with its position."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalink.runtime import broadcast_if_small, cut

#: Candidate delimiters by name. "words" takes blanks one by one.
DELIMITERS = {
    "semicolon": r";", "bar": r"\|", "line": r"[\r\n]", "tab": r"\t", "slashes": r"//", "spaced slash": r"(?<=\s)/(?=\s|$)|^/(?=\s)",
    "slash": r"(?<![\s/])/(?![\s/])", "comma": r",", "blanks": r"(?<=[^\s;|/,])[ \u00a0]{2,}(?=[^\s;|/,])", "words": r"[ \u00a0]",
}

#: What one value looks like, by kind of field; matched against a stripped piece.
KINDS = {
    "isbn": r"(?:97[89](?:[-\u00a0 ]?\d){9}[-\u00a0 ]?[\dXx]|\d(?:[-\u00a0 ]?\d){8}[-\u00a0 ]?[\dXx])(?:\s*\(.*\))?",
    # Family name, given name and perhaps years; or a body of two words or more. No delimiter stands in it.
    "inverted name": r"[^;|\t\r\n,/]+,\s*[^;|\t\r\n,]+(?:,\s*\d{4}\s*-\s*(?:\d{4})?)?|[^;|\t\r\n,\s]+(?:\s+[^;|\t\r\n,\s]+)+(?:,\s*\d{4}\s*-\s*(?:\d{4})?)?",
    # Given name and family name, or a body, and perhaps a role in brackets.
    "contributor": r"[^;|\t\r\n,/()\s]+(?:/\w+)?(?:\s+[^;|\t\r\n,/()\s]+)+\s*(?:\(.*\))?|\w+\s*\(.*\)|Collectif",
}
#: A delimiter is used for a source when its score, regularity times consistency, is at least this.
GOOD = 0.7
#: Pieces and rows of the whole table that a source's own counts are weighed against.
PRIOR = 20.0

#: Characters without which a candidate cuts nothing.
_MARKS = {"semicolon": ";", "bar": "|", "line": "\r\n", "tab": "\t", "slashes": "/", "spaced slash": "/", "slash": "/", "comma": ",", "blanks": " \u00a0", "words": " \u00a0"}
_COARSE = ("semicolon", "bar", "line", "tab")

_QUOTES = {'"': '"', "«": "»", "“": "”"}


def _shield(text: str) -> list[tuple[int, int]]:
    """Spans that no delimiter may cut: quoted values and what stands in brackets. One pass over the text."""
    if not any(ch in text for ch in '("«“'):
        return []
    spans, i, n = [], 0, len(text)
    opens: list[int] = []
    fresh = True  # only blanks or delimiters since the last value ended: a quotation mark opens a value here
    while i < n:
        ch = text[i]
        if ch in _QUOTES and not opens and fresh:
            end, j = _QUOTES[ch], i + 1
            while j < n:
                j = text.find(end, j)
                if j < 0:
                    break
                if end == '"' and text[j + 1 : j + 2] == '"':
                    j += 2
                    continue
                break
            if 0 <= j < n:
                spans.append((i, j + 1))
                i, fresh = j + 1, False
                continue
        if ch == "(":
            opens.append(i)
        elif ch == ")" and opens:
            start = opens.pop()
            if not opens:
                spans.append((start, i + 1))
        fresh = ch in ";|\t\r\n,/ \u00a0"
        i += 1
    return spans


def _cut(text: str, pattern: re.Pattern, spans: list[tuple[int, int]] | None = None) -> list[str]:
    """Pieces between the matches of pattern that lie in no shielded span."""
    if spans is None:
        spans = _shield(text)
    pieces, last, k = [], 0, 0
    for m in pattern.finditer(text):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        if k < len(spans) and spans[k][0] <= m.start():
            continue
        pieces.append(text[last : m.start()])
        last = m.end()
    pieces.append(text[last:])
    return pieces


@cache
def _pattern(names: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(f"(?:{DELIMITERS[n]})" for n in names))


@cache
def _kind(kind: str) -> re.Pattern:
    return re.compile(KINDS[kind], re.S)


@cache
def _kind_at(kind: str) -> re.Pattern:
    return re.compile(KINDS[kind].replace(r"(?:\s*\(.*\))?", r"(?![\dXx])(?:\s*\([^()]*\))?"), re.S)


def _bare(piece: str) -> str:
    """A piece without outer blanks and the quotation marks around all of it; doubled ones within made single."""
    piece = piece.strip()
    if len(piece) >= 2 and piece[0] in _QUOTES and piece[-1] == _QUOTES[piece[0]]:
        piece = piece[1:-1].replace('""', '"').strip() if piece[0] == '"' else piece[1:-1].strip()
    return piece


def _regular(piece: str, kind: str) -> bool:
    quoted = piece.strip()[:1] in _QUOTES
    return bool(quoted or _kind(kind).fullmatch(_bare(piece)))


def values_of(text: str | None, kind: str, delimiters: tuple[str, ...]) -> list[str]:
    """The values of one field under the delimiters found for its source.

    Strong delimiters cut wherever they stand outside quotation marks and brackets. Single blanks cut a piece
    only if every part is then of the kind, so that a number written with blanks stays whole.
    """
    text = (text or "").strip()
    if not text:
        return []
    strong = tuple(d for d in delimiters if d != "words" and _marked(text, d))
    pieces = _cut(text, _pattern(strong)) if strong else [text]
    if "words" in delimiters:
        finer = []
        for p in pieces:
            if _kind(kind).fullmatch(p.strip()):
                finer.append(p)
                continue
            parts = _blank_parts(p.strip(), kind)
            finer += parts or [p]
        pieces = finer
    return [v for v in map(_bare, pieces) if v]


def _blank_parts(piece: str, kind: str) -> list[str]:
    """The piece as values of the kind with blanks between them, or nothing if it is not such a row."""
    parts, at, found = [], 0, _kind_at(kind)
    while at < len(piece):
        m = found.match(piece, at)
        if not m:
            return []
        parts.append(m.group())
        at = m.end()
        gap = re.compile(r"[ \u00a0]*").match(piece, at).end()
        if gap == at < len(piece):
            return []
        at = gap
    return parts


def _marked(text: str, name: str) -> bool:
    return any(ch in text for ch in _MARKS[name])


def judged(value: str, kind: str) -> Iterator[tuple[str, int, int, bool]]:
    """(candidate, pieces, regular pieces, consistent) for each candidate that cuts a value.

    Pieces are judged after all coarser candidates. The cut is consistent if it leaves as many pieces as there
    are values: every piece is one or is made of several under other candidates, and none is left empty-handed
    between two that are whole. Single blanks are judged by whether an irregular piece falls wholly into values.
    """
    value = value.strip()
    spans = _shield(value)
    for name in DELIMITERS:
        if not _marked(value, name):
            continue
        if name == "words":
            whole = [p.strip() for p in _cut(value, _pattern(("semicolon", "bar", "line", "tab", "slashes", "slash", "comma", "blanks")), spans)]
            parts = [_blank_parts(p, kind) for p in whole if " " in p and not _kind(kind).fullmatch(p)]
            if parts:
                yield name, len(parts), sum(map(bool, parts)), all(parts)
            continue
        pieces = [p for p in _cut(value, _pattern((name,)), spans) if p.strip()]
        if len(pieces) < 2:
            continue
        inner = [q for p in pieces for q in (_cut(p, _pattern(_COARSE)) if any(_marked(p, c) for c in _COARSE) else [p]) if q.strip()]
        good = [_regular(q, kind) or _mixed(q, kind) for q in inner]
        yield name, len(inner), sum(good), sum(good) == len(inner)


def infer_delimiters(rows: DataFrame, source: str, text: str, kind: str) -> DataFrame:
    """(source, delimiters): for each source the candidates that cut its fields into regular pieces in consistent numbers.

    A candidate's regularity is the share of its pieces that have the kind, over all rows that it cuts; its
    consistency is the share of these rows whose number of pieces is their number of values (see judged). The
    score is their product, each weighed against that of the whole table, so that a source with few rows
    follows the table. Partial sums leave each task, so a source with most of the rows is no burden. A null
    source is a source of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str | None, str], list[int]] = {}
        for one in batches:
            for src, value in zip(one.column(0).to_pylist(), one.column(1).to_pylist(), strict=True):
                sums.setdefault((src, ""), [0, 0, 0, 0])
                if not value or not value.strip():
                    continue
                for name, pieces, regular, consistent in judged(value, kind):
                    got = sums.setdefault((src, name), [0, 0, 0, 0])
                    got[0], got[1], got[2], got[3] = got[0] + 1, got[1] + consistent, got[2] + pieces, got[3] + regular
        yield pa.RecordBatch.from_pydict(
            {"src": pa.array([k[0] for k in sums], pa.string()), "name": pa.array([k[1] for k in sums], pa.string()), **{c: pa.array([v[i] for v in sums.values()], pa.int64()) for i, c in enumerate(("n", "consistent", "pieces", "regular"))}}
        )

    counts = ("n", "consistent", "pieces", "regular")
    counted = rows.select(F.col(source).cast("string").alias("src"), F.col(text).alias("text")).mapInArrow(run, "src string, name string, n long, consistent long, pieces long, regular long")
    counted = cut(counted.groupBy("src", "name").agg(*[F.sum(c).alias(c) for c in counts]))
    # One row per candidate, ten at most: the table's own shares.
    overall = counted.where("name <> ''").groupBy("name").agg((F.sum("regular") / F.sum("pieces")).alias("regularity"), (F.sum("consistent") / F.sum("n")).alias("consistency")).collect()
    weighed = lambda won, of, share: (F.coalesce(won, F.lit(0)) + F.lit(PRIOR * share)) / (F.coalesce(of, F.lit(0)) + F.lit(PRIOR))
    good = []
    for r in overall:
        own = [F.max(F.when(F.col("name") == r["name"], F.col(c))) for c in counts]
        score = weighed(own[3], own[2], r["regularity"]) * weighed(own[1], own[0], r["consistency"])
        good.append(F.when(score >= GOOD, r["name"]))
    chosen = F.array_sort(F.filter(F.array(*good), lambda x: x.isNotNull())) if good else F.array().cast("array<string>")
    return counted.groupBy("src").agg(chosen.alias("delimiters"))


def _mixed(piece: str, kind: str) -> bool:
    """Whether a piece is made of regular values under the other candidates."""
    others = {"isbn": ("slashes", "slash", "comma", "blanks"), "inverted name": ("slashes",), "contributor": ("slashes", "spaced slash", "comma")}[kind]
    parts = [p for p in _cut(piece, _pattern(others)) if p.strip()]
    return len(parts) > 1 and all(_kind(kind).fullmatch(_bare(p)) or (kind == "isbn" and _blank_parts(p.strip(), kind)) for p in parts)


def split_values(rows: DataFrame, key: str, source: str, text: str, kind: str) -> DataFrame:
    """(key, rang, valeur): one row per value of a packed field, rang from 1 in written order.

    Null, empty and blank fields give no row, empty values between delimiters no rang. Repeated rows give
    repeated values. Texts are cut whole, however long. Columns other than the three named are not read.
    """
    found = broadcast_if_small(cut(infer_delimiters(rows, source, text, kind)))
    ready = rows.select(F.col(key).alias("k"), F.col(source).cast("string").alias("s"), F.col(text).alias("text")).where(F.length(F.trim("text")) > 0)
    ready = ready.join(found, F.col("s").eqNullSafe(F.col("src")), "left").select("k", "text", F.coalesce("delimiters", F.array().cast("array<string>")).alias("delimiters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            values = [values_of(t, kind, tuple(d)) for t, d in zip(one.column(1).to_pylist(), one.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([one.column(0), pa.array(values, pa.list_(pa.string()))], names=["k", "values"])

    schema = f"k {ready.schema['k'].dataType.simpleString()}, values array<string>"
    return ready.mapInArrow(run, schema).select(F.col("k").alias(key), F.posexplode("values").alias("rang", "valeur")).withColumn("rang", (F.col("rang") + 1).cast("int"))
