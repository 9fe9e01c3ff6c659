"""Date parsing by a list of ``strptime`` formats (K7) and age in years (K8).

``try_to_date`` is more lenient than ``strptime`` (it takes ``001`` as a day and
year ``0000``), so each format is guarded by a regular expression that accepts
exactly what ``strptime`` accepts: 1-2 digit day and month (the day may also be
a space and one digit), a 4-digit year from 0001.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The strptime field grammars used by the rules.
_DAY = r"(3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9])"
_MONTH = r"(1[0-2]|0[1-9]|[1-9])"
_YEAR = r"(?!0000)[0-9]{4}"

# strptime format -> (guard regex, Spark pattern)
FORMATS = {
    "%d/%m/%Y": (f"^{_DAY}/{_MONTH}/{_YEAR}$", "d/M/yyyy"),
    "%m/%d/%Y": (f"^{_MONTH}/{_DAY}/{_YEAR}$", "M/d/yyyy"),
    "%Y-%m-%d": (f"^{_YEAR}-{_MONTH}-{_DAY}$", "yyyy-M-d"),
}


def parse_date(s: Column, fmt: str) -> Column:
    """Date of ``s`` under one strptime format, NULL when it does not parse."""
    guard, pattern = FORMATS[fmt]
    # the only space the guard lets through sits before a one-digit day
    return F.when(s.rlike(guard), F.try_to_date(F.replace(s, F.lit(" "), F.lit("")), pattern))


def parse_first(s: Column, fmts: list[str]) -> Column:
    """The first format that parses decides (``for fmt in fmts: try strptime``)."""
    return F.coalesce(*[parse_date(s, f) for f in fmts])


def full_years(as_of: Column, born: Column) -> Column:
    """Completed years between two dates (``relativedelta(as_of, born).years``)."""
    return F.floor(F.months_between(as_of, born) / F.lit(12)).cast("int")
