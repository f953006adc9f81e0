"""Garbled text from wrong character encodings: noisy-channel decoding over byte lattices."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalink.runtime import broadcast_if_small, cut

#: Channels by name: (encoding of the bytes, encoding they were read in, times).
CHANNELS = {
    "utf-8 as cp1252": ("utf-8", "cp1252", 1),
    "utf-8 as cp1252 twice": ("utf-8", "cp1252", 2),
    "utf-8 as cp1250": ("utf-8", "cp1250", 1),
    "utf-8 as cp1251": ("utf-8", "cp1251", 1),
    "utf-8 as cp1254": ("utf-8", "cp1254", 1),
    "utf-8 as latin-9": ("utf-8", "iso8859-15", 1),
    "utf-8 as latin-2": ("utf-8", "iso8859-2", 1),
    "utf-8 as mac": ("utf-8", "mac_roman", 1),
    "utf-8 as cp437": ("utf-8", "cp437", 1),
    "utf-8 as cp850": ("utf-8", "cp850", 1),
    "cp1252 as mac": ("cp1252", "mac_roman", 1),
    "cp1252 as cp437": ("cp1252", "cp437", 1),
    "cp1252 as cp850": ("cp1252", "cp850", 1),
    "cp1252 as cp1250": ("cp1252", "cp1250", 1),
    "cp1252 as cp1251": ("cp1252", "cp1251", 1),
    "cp1252 as cp1253": ("cp1252", "cp1253", 1),
    "cp1252 as koi8": ("cp1252", "koi8_r", 1),
    "mac as cp1252": ("mac_roman", "cp1252", 1),
    "cp850 as cp1252": ("cp850", "cp1252", 1),
    "cp1252 as utf-8": ("cp1252", "utf-8", 1),
}
#: What stands for a lost byte in garbled text.
LOST = "�"
#: A run of ASCII letters and of anything beyond ASCII: the span that is decoded as one.
PIECE = r"[A-Za-z\x{80}-\x{10FFFF}]*[\x{80}-\x{10FFFF}][A-Za-z\x{80}-\x{10FFFF}]*"
TOKEN = r"[\p{L}\p{M}]+|[^\p{L}\p{M}\s\x{0}-\x{7F}]"
#: Log-probabilities of a field's first damaged piece and of a change between channels within a field.
ENTER, SWITCH = -2.0, -2.0
#: A piece is looked at in its field if some reading comes within this of the piece as it stands.
NEAR = 1.0
#: A piece that is whole multi-byte UTF-8 is hardly ever so by chance.
WHOLE_UTF8 = 4.0
#: Letters of two scripts side by side in one piece are hardly ever meant.
MIXED, MIXED_SCRIPTS = r"[A-Za-z][\p{IsCyrillic}\p{IsGreek}]|[\p{IsCyrillic}\p{IsGreek}][A-Za-z]", 3.0
#: Signs that a right reading hardly ever holds: all beyond ASCII but the usual ones.
ODD_SIGN = r"[^\p{L}\p{M}\x{0}-\x{7F}’‘“”«»–—…°©®™€£½¼¾²³¿¡§·•№]"
#: Slots of the letter model: letter pairs are counted by hash, so its size is the same for every alphabet.
SLOTS = 1 << 18
#: Spans with lost bytes are looked up among corpus words up to this length; longer ones are read letter by letter.
LONGEST_WORD = 40


def plain_case(word: str) -> str:
    """A word in capitals counts as its lower-case form."""
    return word.lower() if len(word) > 1 and word == word.upper() else word


def slot(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % SLOTS


@dataclass
class Letters:
    """A bigram model of letters: counts of pairs and of first letters by slot, at most SLOTS of each."""

    pairs: dict[int, float] = field(default_factory=dict)
    firsts: dict[int, float] = field(default_factory=dict)

    def step(self, a: str, b: str) -> float:
        total = self.firsts.get(slot(a))
        return math.log((self.pairs.get(slot(a + b), 0.0) + 0.02) / (total + 20.0)) if total else -12.0

    def word(self, w: str) -> float:
        total, a = 0.0, "^"
        for b in plain_case(w):
            total += self.step(a, b)
            a = b
        return total + self.step(a, "$")


def _tables() -> tuple[dict[str, dict[str, int]], dict[str, dict[int, str]]]:
    """For each single-byte encoding the byte of a character and the character of a byte.

    Bytes without character keep their control character, as most readers leave them.
    """
    to: dict[str, dict[str, int]] = {}
    of: dict[str, dict[int, str]] = {}
    for name in {e for x in CHANNELS.values() for e in x[:2]} - {"utf-8"}:
        chars = {}
        for b in range(256):
            try:
                chars[b] = bytes([b]).decode(name)
            except UnicodeDecodeError:
                chars[b] = chr(b)
        of[name] = chars
        to[name] = {c: b for b, c in chars.items()} | ({chr(b): b for b in range(0x80, 0xA0) if chr(b) not in chars.values()} if name in ("cp1252", "cp1254", "cp1250", "iso8859-15") else {})
    return to, of


def _utf8_from(lattice: list[int | None], i: int) -> list[tuple[int, str]]:
    """Characters that may start at place i of a byte lattice, with the place after each; None is any byte beyond ASCII.

    A character of three or four bytes needs its first byte or all the others.
    """
    b = lattice[i]
    if b is not None and b < 0x80:
        return [(i + 1, chr(b))]
    out = []
    for size, first, last, mask in ((2, 0xC2, 0xDF, 0x1F), (3, 0xE0, 0xEF, 0x0F), (4, 0xF0, 0xF4, 0x07)):
        tail = lattice[i + 1 : i + size]
        if len(tail) < size - 1 or any(x is not None and not 0x80 <= x <= 0xBF for x in tail):
            continue
        if b is None and size > 2 and None in tail or size == 4 and tail.count(None) > 1:
            continue
        points = [lead & mask for lead in ([b] if b is not None else range(first, last + 1)) if first <= lead <= last]
        for x in tail:
            points = [p << 6 | low & 0x3F for p in points for low in ([x] if x is not None else range(0x80, 0xC0))]
        least = (0x80, 0x800, 0x10000)[size - 2]
        out += [(i + size, chr(p)) for p in points if least <= p <= 0x10FFFF and not 0xD800 <= p <= 0xDFFF]
    return out


def image(word: str, true: str, read: str, times: int, to: dict, of: dict) -> str | None:
    """What a word becomes in a channel, lost bytes as LOST; None if the channel has no way to write it."""
    for _ in range(times):
        try:
            raw = word.encode("utf-8") if true == "utf-8" else bytes(ord(c) if c.isascii() else to[true][c] for c in word)
        except (KeyError, UnicodeEncodeError):
            return None
        if read == "utf-8":
            word = raw.decode("utf-8", "replace")
        else:
            word = "".join(c if c.isprintable() or b < 0x80 or c == "\xa0" or c == "\xad" else LOST for b, c in ((b, of[read][b]) for b in raw))
    return word


def word_spans(piece: str) -> list[tuple[int, int]]:
    """(start, end) of the spans of a piece that may be a word: they begin and end at its ends or at lost bytes."""
    at = [0, *sorted({x for i, c in enumerate(piece) if c == LOST or not c.isalpha() for x in (i, i + 1)} - {0, len(piece)}), len(piece)]
    return [(i, j) for n, i in enumerate(at) for j in at[n + 1 :] if j - i <= LONGEST_WORD]


def readings(piece: str, letters: Letters, tables: tuple | None = None, arcs: list[tuple[int, int, str, str, float]] = (), unknown: float = -16.0) -> list[tuple[str, str]]:
    """(channel, text): the best decoding of a piece in each channel, by Viterbi search over its byte lattice.

    arcs are corpus words that may stand in the piece: (start, end, channel or "" for any, word, log-frequency).
    """
    to, of = tables or _tables()
    found: list[tuple[str, str]] = []
    known = "".join(c for c in piece if c.isascii())
    capitals = bool(known) and known == known.upper()
    for name, (true, read, times) in CHANNELS.items():
        text: str | None = piece
        for n in range(times):
            own = [(i, j, w, lp) for i, j, channel, w, lp in arcs if channel in ("", name)] if times == 1 or not n else []
            moves = _moves(text, true, read, to, of)
            text = viterbi(moves, letters, own if times == 1 else [], unknown, capitals) if moves else None
            if text is None:
                break
        if text is not None and text != piece:
            found.append((name, text))
    return found


def _moves(piece: str, true: str, read: str, to: dict, of: dict) -> list[list[tuple[int, str]]] | None:
    """The byte lattice of a piece as the characters that may start at each place; None if the channel can't give it."""
    if read == "utf-8":
        if LOST not in piece:
            return None
        high = [c for b, c in of[true].items() if b >= 0x80 and c.isprintable()]
        return [[(i + 1, x) for x in (high if c == LOST else [c])] for i, c in enumerate(piece)]
    lattice: list[int | None] = []
    for c in piece:
        b = None if c == LOST else to[read].get(c)
        if b is None and c != LOST:
            return None
        lattice.append(b)
    if true != "utf-8":
        high = [c for b, c in of[true].items() if b >= 0x80 and c.isprintable()]
        return [[(i + 1, x) for x in (high if b is None else [of[true][b]])] for i, b in enumerate(lattice)]
    if not any(b is None or b >= 0xC2 for b in lattice):
        return None
    moves = [_utf8_from(lattice, i) for i in range(len(lattice))]
    # A letter whose last byte, a blank to many readers, was trimmed: the lead byte alone stands for it.
    if lattice[-1] == 0xC3 and not moves[-1]:
        moves[-1] = [(len(lattice), "à")]
    return moves


def viterbi(moves: list[list[tuple[int, str]]], letters: Letters, arcs: list[tuple[int, int, str, float]] = (), unknown: float = -16.0, capitals: bool = False) -> str | None:
    """The likeliest text along a lattice, None if no path goes through.

    States are places with the last letter of an unfinished word, or none between words; of each only the best
    path lives on, so the search is exact. A path's score is half the log-frequency of its words and half
    their log-probability by letters. Corpus words enter as arcs over whole spans; a word spelled letter by
    letter counts as unknown. Among capitals letters count as lower-case ones, real lower-case ones less.
    """
    n = len(moves)
    best: list[dict[str, tuple[float, str]]] = [{} for _ in range(n + 1)]
    best[0][""] = (0.0, "")
    words: dict[int, list[tuple[int, str, float]]] = {}
    for i, j, w, lp in arcs:
        words.setdefault(i, []).append((j, w, 0.5 * lp + 0.5 * letters.word(w)))

    def offer(place: int, state: str, score: float, text: str) -> None:
        held = best[place].get(state)
        if held is None or score > held[0]:
            best[place][state] = (score, text)

    for i in range(n + 1):
        for last, (score, text) in list(best[i].items()):
            if last:
                offer(i, "", score + 0.5 * letters.step(last, "$") + 0.5 * unknown, text)
        if i == n:
            break
        for last, (score, text) in list(best[i].items()):
            if not last:
                for j, w, gain in words.get(i, ()):
                    offer(j, "", score + gain, text + w)
            for j, c in moves[i]:
                if c.isalpha():
                    x = c.lower() if capitals and len(c.lower()) == 1 else c
                    offer(j, x, score + 0.5 * letters.step(last or "^", x) - (capitals and c.islower()), text + c)
                elif not last:
                    # An apostrophe between letters says little; other signs count as unknown unless an arc has them.
                    quiet = c in "’'" and text[-1:].isalpha()
                    offer(j, "", score + (-1.0 if quiet else 0.5 * letters.word(c) + 0.5 * unknown), text + c)
    return best[n][""][1] if "" in best[n] else None


def _tokens(text: str) -> list[str]:
    import regex

    return regex.findall(r"[\p{L}\p{M}]+|[^\p{L}\p{M}\s\x00-\x7f]", text)


def _scored(text: str) -> list[str]:
    """The tokens that speak for or against a reading: an apostrophe between two letters says nothing."""
    import regex

    return _tokens(regex.sub(r"(?<=\p{L})’(?=\p{L})", " ", text))


def _surely(text: str) -> bool:
    """Holds a lost byte or a control character that no text has."""
    return any(c == LOST or "\x80" <= c <= "\x9f" for c in text)


def best_path(pieces: list[tuple[int, str, list[tuple[str, str, float]]]]) -> list[tuple[int, str]]:
    """Viterbi over the suspected pieces of one field: the readings to put in, by place.

    States are channels ("" for rightly read). A piece offers its readings with their scores; entering
    damage and changing channel cost, staying in a channel does not.
    """
    best: dict[str, tuple[float, list[tuple[int, str]]]] = {"": (0.0, [])}
    for place, piece, options in sorted(pieces):
        now: dict[str, tuple[float, list[tuple[int, str]]]] = {}
        for channel, text, score in options:
            for before, (total, path) in best.items():
                if not channel or channel == before:
                    cost = 0.0
                else:
                    cost = SWITCH if before else ENTER
                put = path if not channel else [*path, (place, text)]
                # A right piece leaves the channel as it was.
                state = channel or before
                if state not in now or now[state][0] < total + score + cost:
                    now[state] = (total + score + cost, put)
        best = now or best
    return max(best.values(), key=lambda x: x[0])[1]


def restore(rows: DataFrame, entity: str = "entity", key: str = "row_key", text: str = "text") -> DataFrame:
    """(entity, key, text, restored): the rows with wrongly decoded characters and their likeliest text.

    Corpus: the frequencies of all tokens of all rows, and the letter pairs of these tokens. For each distinct
    piece beyond ASCII each channel's byte lattice gives its likeliest reading by Viterbi search, lost bytes being
    wildcards; where bytes are lost, the corpus words that become a span of the piece in the channel are arcs of
    the lattice. A text's score is the mean of its tokens' log-frequency and of their log-probability by letters, and more for whole UTF-8. In each field the
    suspected pieces are decoded together by Viterbi search over channels. Every row with a lost byte (U+FFFD)
    or a C1 control character is returned, restored as far as a reading was found.

    Null and empty texts are never returned; repeated rows count as evidence like others and are returned
    each; extra columns are not read. Texts are decoded whole. An empty table gives an empty result.
    """
    rows = rows.select(F.col(entity).alias("entity"), F.col(key).alias("row_key"), F.col(text).alias("text")).where(F.length("text") > 0)
    spark = rows.sparkSession
    plain = lambda t: F.when((F.length(t) > 1) & (F.upper(t) == t), F.lower(t)).otherwise(t)
    vocabulary = cut(rows.select(F.explode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("token")).groupBy(plain(F.col("token")).alias("token")).agg(F.count("*").alias("n")))
    total = vocabulary.agg(F.sum("n")).first()[0] or 1
    unknown = math.log(0.05 / float(total))
    spelled = F.concat(F.array(F.lit("^")), F.split(F.col("token"), ""), F.array(F.lit("$")))
    at = lambda text: F.pmod(F.crc32(text.cast("binary")), F.lit(SLOTS)).cast("int")
    steps = F.flatten(F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.array(F.struct(F.lit(True).alias("pair"), at(F.concat(F.get("c", i), F.get("c", i + 1))).alias("slot")), F.struct(F.lit(False).alias("pair"), at(F.get("c", i)).alias("slot")))))
    slots = vocabulary.select("n", spelled.alias("c")).select("n", F.explode(steps).alias("s")).groupBy("s.pair", "s.slot").agg(F.sum("n").alias("n"))
    model = Letters()
    for r in slots.toLocalIterator():
        (model.pairs if r.pair else model.firsts)[r.slot] = float(r.n)
    letters = spark.sparkContext.broadcast((model.pairs, model.firsts))  # plain values: workers need not import this module

    pieces = cut(rows.select(F.explode(F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))).alias("piece")).groupBy("piece").agg(F.count("*").alias("seen")).select("piece"))

    def imagine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to, of = _tables()
        for batch in batches:
            out = []
            for token, lp in zip(batch["token"], batch["lp"], strict=True):
                out.append((token, "", token, lp))
                # A word known in one case stands, a little less likely, for its other cases.
                for word in dict.fromkeys((token, token.lower(), token.upper(), token.capitalize())) if not token.isascii() else ():
                    for name, channel in CHANNELS.items():
                        seen = image(word, *channel, to, of) if channel[2] == 1 else None
                        if seen and LOST in seen:
                            out.append((seen, name, word, lp if word == token else lp - 1.0))
            yield pd.DataFrame(out, columns=["image", "channel", "word", "lp"])

    def lookups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(p, i, j, p[i:j]) for p in batch["piece"] for i, j in word_spans(p)], columns=["piece", "i", "j", "image"])

    short = vocabulary.where(F.length("token") <= LONGEST_WORD).select("token", F.log((F.col("n") + 0.05) / F.lit(float(total))).alias("lp"))
    images = short.mapInPandas(imagine, "image string, channel string, word string, lp double")
    asked = pieces.where(F.col("piece").contains(LOST)).mapInPandas(lookups, "piece string, i int, j int, image string")
    # Words that a piece with lost bytes may hold: their number is bounded by its spans and by the words of one image.
    arcs = asked.join(images, "image").groupBy("piece").agg(F.collect_list(F.struct("i", "j", "channel", "word", "lp")).alias("arcs"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, tables = Letters(*letters.value), _tables()
        for batch in batches:
            out: list[tuple] = []
            for piece, arcs in zip(batch["piece"], batch["arcs"], strict=True):
                found = [] if arcs is None else [(x["i"], x["j"], x["channel"], x["word"], x["lp"]) for x in arcs]
                for channel, t in [("", piece), *readings(piece, model, tables, found, unknown)]:
                    words = [plain_case(w) for w in _scored(t)]
                    out.append((piece, channel, t, words, float(sum(map(model.word, words)))))
            yield pd.DataFrame(out, columns=["piece", "channel", "reading", "tokens", "by_letters"])

    read = cut(pieces.join(arcs, "piece", "left").mapInPandas(decode, "piece string, channel string, reading string, tokens array<string>, by_letters double"))
    known = vocabulary.select("token", F.log((F.col("n") + 0.05) / F.lit(float(total))).alias("lp"))
    by_words = read.select("piece", "channel", "reading", F.explode("tokens").alias("token")).join(known, "token", "left").groupBy("piece", "channel", "reading").agg(F.sum(F.coalesce("lp", F.lit(unknown))).alias("by_words"))
    sure = F.col("piece").rlike("[\\x{80}-\\x{9F}\\x{FFFD}]")
    scored = (
        read.join(by_words, ["piece", "channel", "reading"], "left")
        .withColumn("score", 0.5 * F.coalesce("by_words", F.lit(0.0)) + 0.5 * F.col("by_letters") - F.when(F.col("reading").rlike("[\\x{80}-\\x{9F}\\x{FFFD}\\x{A0}\\x{AD}]") | (F.size("tokens") == 0), 40.0).otherwise(0.0) + F.when(F.col("channel").startswith("utf-8 as"), WHOLE_UTF8).otherwise(0.0) + F.when((F.col("channel") != "") & F.col("piece").rlike(MIXED), MIXED_SCRIPTS).otherwise(0.0) - F.when((F.col("channel") != "") & F.col("reading").rlike(ODD_SIGN), 8.0).otherwise(0.0))
        .groupBy("piece", "channel")
        .agg(F.max(F.struct("score", "reading")).alias("x"))
        .groupBy("piece")
        .agg(F.collect_list(F.struct("channel", F.col("x.reading").alias("reading"), F.col("x.score").alias("score"))).alias("options"))
        .withColumn("as_is", F.element_at(F.filter("options", lambda o: o.channel == ""), 1).score)
        .withColumn("options", F.filter("options", lambda o: (o.channel == "") | (o.score > F.col("as_is") - NEAR)))
        .where((F.size("options") > 1) | sure)
        .select("piece", "options")
    )
    scored = cut(scored)
    spans = F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))
    odd = rows.where(F.col("text").rlike("[^\\x{0}-\\x{7F}]"))
    met = odd.select("entity", "row_key", "text", F.posexplode(spans).alias("place", "piece")).join(broadcast_if_small(scored), "piece")
    fields = met.groupBy("entity", "row_key").agg(F.first("text").alias("text"), F.collect_list(F.struct("place", "piece", "options")).alias("pieces"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        cutter = regex.compile(r"[A-Za-z\x80-\U0010FFFF]*[\x80-\U0010FFFF][A-Za-z\x80-\U0010FFFF]*")
        for batch in batches:
            out = []
            for e, k, t, found in zip(batch["entity"], batch["row_key"], batch["text"], batch["pieces"], strict=True):
                path = dict(best_path([(p["place"], p["piece"], [(o["channel"], o["reading"], o["score"]) for o in p["options"]]) for p in found]))
                if not path and not _surely(t):
                    continue
                number = iter(range(1 << 62))
                out.append((e, k, t, cutter.sub(lambda m: path.get(next(number), m.group()), t)))  # noqa: B023
            yield pd.DataFrame(out, columns=["entity", "row_key", "text", "restored"])

    return fields.mapInPandas(choose, "entity string, row_key string, text string, restored string")


def library_texts(notices: DataFrame, books: DataFrame, authors: DataFrame) -> DataFrame:
    """(entity, row_key, text): titles of notices and pages, and bios of authors."""
    return (
        notices.select(F.lit("livre").alias("entity"), F.col("id_livre").cast("string").alias("row_key"), F.col("titre").alias("text"))
        .union(books.select(F.lit("babelio_book"), F.col("rec_id").cast("string"), F.col("title")))
        .union(authors.select(F.lit("babelio_author"), F.col("author_key"), F.col("bio")))
    )
