"""Scalar text helpers (K1-K6, K11) as native Column expressions.

Every rule sees cells as strings where "missing" is ``''``; NULL from a reader
is folded to ``''`` here once, so no rule has to care about it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's ``str.strip()`` removes (``str.isspace``),
# given as inclusive code-point ranges.
_PY_WHITESPACE_RANGES = [
    (0x09, 0x0D), (0x1C, 0x1F), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0),
    (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F),
    (0x205F, 0x205F), (0x3000, 0x3000),
]
PY_WHITESPACE = "".join(chr(c) for lo, hi in _PY_WHITESPACE_RANGES for c in range(lo, hi + 1))


def cell(c: Column | str) -> Column:
    """A raw cell: the string value with NULL read as ``''``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


_OTHER_WS = [ch for ch in PY_WHITESPACE if ch != " "]
_OTHER_WS_CODES = [ord(ch) for ch in _OTHER_WS]


def pystrip(c: Column) -> Column:
    """``str.strip()``: trims the full Unicode whitespace set, not only spaces.

    Fast path: ``trim`` (spaces only) first; the full-set ``btrim`` runs only
    when an end character is still whitespace, which is rare in real data.
    """
    t = F.trim(c)
    # ascii() reads the first code point without copying the string
    other_at_end = F.ascii(t).isin(_OTHER_WS_CODES) | F.substring(t, -1, 1).isin(_OTHER_WS)
    return F.when(other_at_end, F.btrim(t, F.lit(PY_WHITESPACE))).otherwise(t)


def is_blank(c: Column) -> Column:
    """True when the stripped value is empty (``not str(v).strip()``)."""
    return pystrip(c) == F.lit("")


def quoted(v: Column) -> Column:
    """``'{v}'`` as appended to messages that carry the offending value."""
    return F.concat(F.lit("'"), v, F.lit("'"))


def with_value(msg: Column, stripped_value: Column) -> Column:
    """R2: ``{msg}: '{value}'`` with the stripped value."""
    return F.concat(msg, F.lit(": "), quoted(stripped_value))
