"""Declared constraints (U7), compiled to Column checks.

The rule sets declare ``required``, ``min_length``, ``max_length``,
``pattern``, ``values`` and ``min_age`` per field, plus ``conditional`` /
``depends_on``.  The reference never enforces them; this compiler is opt-in
(``validate`` does not call it) and turns the declarations into one narrow
projection: ``row_number, field, constraint, error`` per violated constraint.
Lengths and patterns apply to the stripped value when it is not blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import full_years, parse_first
from ..functions.rules import BIRTHDATE_FORMATS, RowContext
from ..functions.text import pystrip
from . import rulesets as RS

ORDER = ["required", "min_length", "max_length", "pattern", "values", "min_age"]


def constraint_checks(field: str, spec: dict, s: Column, as_of: Column) -> list[tuple[str, Column]]:
    """(constraint, message-or-NULL) pairs for one declared field."""
    out = []
    present = s != F.lit("")
    for kind in ORDER:
        if kind not in spec:
            continue
        arg = spec[kind]
        if kind == "required":
            if arg and not spec.get("conditional"):
                out.append((kind, F.when(~present, F.lit(f"{field} is required"))))
        elif kind == "min_length":
            out.append((kind, F.when(present & (F.length(s) < arg), F.lit(f"{field} shorter than {arg}"))))
        elif kind == "max_length":
            out.append((kind, F.when(present & (F.length(s) > arg), F.lit(f"{field} longer than {arg}"))))
        elif kind == "pattern":
            out.append((kind, F.when(present & ~s.rlike(arg), F.lit(f"{field} does not match {arg}"))))
        elif kind == "values":
            out.append((kind, F.when(present & ~s.isin(list(arg)), F.lit(f"{field} not one of {', '.join(arg)}"))))
        elif kind == "min_age":
            born = parse_first(s, BIRTHDATE_FORMATS)
            out.append((kind, F.when(present & born.isNotNull() & (full_years(as_of, born) < arg),
                                     F.lit(f"{field} younger than {arg}"))))
    return out


def check_declared(df: DataFrame, ruleset: RS.RuleSet | str, as_of: str = "2025-01-01",
                   row_number: str = "row_number") -> DataFrame:
    """Every declared constraint of the rule set over the columns present."""
    if not isinstance(ruleset, RS.RuleSet):
        ruleset = RS.RULESETS[ruleset]
    ctx = RowContext(df.columns, F.lit(as_of).cast("date"))
    items = []
    for field, spec in ruleset.declared.items():
        if not ctx.has(field):
            continue
        s = pystrip(ctx.raw(field))
        for kind, msg in constraint_checks(field, spec, s, ctx.as_of):
            items.append(F.when(msg.isNotNull(), F.array(F.struct(F.lit(field).alias("field"),
                                                                   F.lit(kind).alias("constraint"),
                                                                   msg.alias("error"))))
                         .otherwise(F.array().cast("array<struct<field:string,constraint:string,error:string>>")))
    return (df.select(F.col(row_number).alias("row_number"), F.explode(F.concat(*items)).alias("c"))
              .select("row_number", "c.field", "c.constraint", "c.error"))
