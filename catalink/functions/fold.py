"""Case and accent folding as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _accents() -> tuple[str, str]:
    """Lower-case accented Latin letters and their base letters, from Unicode's decompositions."""
    pairs = {}
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        low = chr(point).lower()
        base = unicodedata.normalize("NFD", low)[0]
        if len(low) == 1 and base != low and base.isascii():
            pairs[low] = base
    pairs |= {"ø": "o", "ł": "l", "đ": "d"}
    return "".join(pairs), "".join(pairs.values())


def fold(c: Column) -> Column:
    """Lower case without accents; ligatures become two letters, combining marks go."""
    letters, bases = _accents()
    plain = F.translate(F.lower(c), letters, bases)
    for a, b in (("œ", "oe"), ("æ", "ae"), ("ß", "ss")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return F.regexp_replace(plain, r"\p{M}", "")


def words(c: Column) -> Column:
    """The folded words (runs of letters and digits) of a text; null gives an empty list."""
    return F.coalesce(F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))
