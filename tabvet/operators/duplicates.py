"""Duplicate keys.

All four keys are unpivoted into one narrow ``(row_number, field, value)``
stream, so a single aggregation on (field, value) serves every key.  The
aggregation is partial + final (map-side combine), so a value held by a third
of all rows still arrives at the reducer as one partial row per map task.  The
per-row answers (the index of A1-A6, the first-seen flag of A8) join the stream
back to the duplicated groups, which are written once; a hot value is salted
(:func:`tabvet.operators.skew.join_groups`).  Nothing is collected into a group: the
"value -> rows" map of the reference is returned in long form, one row per (value, row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import RowContext
from ..functions.text import pystrip
from ..session import written
from .skew import join_groups

# Duplicate keys, in the order the row profile checks them, with
# the words of their messages.
DUPLICATE_KEYS = ["email", "username", "personalid", "idcardno"]
DUPLICATE_WORDS = {"email": "email", "username": "username", "personalid": "personal ID",
                   "idcardno": "ID card number"}
# the row profile keeps the case of ids; the bulk profile folds every key
ROW_LOWERED = {"email", "username"}


def _normalised(field: str, raw: Column, profile: str) -> Column:
    s = pystrip(raw)
    return F.lower(s) if (profile == "bulk" or field in ROW_LOWERED) else s


def duplicate_keys(df: DataFrame, fields: list[str] | None = None, profile: str = "row",
                   row_number: str = "row_number") -> DataFrame:
    """``row_number, code, field, value`` for every non-empty key cell.

    Row profile: a cell counts when its raw text is not empty (a blank one is
    the value ``''``).  Bulk profile: stripped and lower-cased, blanks skipped.
    """
    fields = fields or DUPLICATE_KEYS
    ctx = RowContext(df.columns, F.current_date())
    code = ctx.raw("code") if ctx.has("code") else F.lit("N/A")
    items = []
    for f in fields:
        if not ctx.has(f):
            continue
        raw = ctx.raw(f)
        v = _normalised(f, raw, profile)
        keep = (raw != F.lit("")) if profile == "row" else (v != F.lit(""))
        items.append(F.when(keep, F.struct(F.lit(f).alias("field"), v.alias("value"))))
    if not items:
        return df.sparkSession.createDataFrame(
            [], "row_number bigint, code string, field string, value string")
    return (df.select(F.col(row_number).alias("row_number"), code.alias("code"),
                      F.explode(F.array_compact(F.array(*items))).alias("k"))
              .select("row_number", "code", "k.field", "k.value"))


def duplicate_groups(keys: DataFrame) -> DataFrame:
    """``field, value, first_row, n`` for values held by two or more rows."""
    return (keys.groupBy("field", "value")
                .agg(F.min("row_number").alias("first_row"), F.count(F.lit(1)).alias("n"))
                .where(F.col("n") > 1))


def duplicate_index(df: DataFrame, fields: list[str] | None = None, profile: str = "bulk",
                    row_number: str = "row_number") -> DataFrame:
    """``field, value, row_index`` (0-based) for every row of a duplicated value."""
    keys = duplicate_keys(df, fields, profile, row_number)
    groups = written(duplicate_groups(keys), "duplicates")
    return (join_groups(keys.drop("code"), groups, ["field", "value"], "n")
                .select("field", "value", (F.col("row_number") - 1).alias("row_index")))


def duplicate_counts(df: DataFrame, fields: list[str] | None = None, profile: str = "bulk",
                     row_number: str = "row_number") -> DataFrame:
    """``field, n_values`` (values with >= 2 rows), one row per field, zeros kept."""
    fields = fields or DUPLICATE_KEYS
    return count_groups(duplicate_groups(duplicate_keys(df, fields, profile, row_number)), fields)


def count_groups(groups: DataFrame, fields: list[str]) -> DataFrame:
    """A7 from the groups: ``field, n_values``."""
    one_row = groups.agg(*[F.count_if(F.col("field") == F.lit(f)).alias(f"c{i}")
                           for i, f in enumerate(fields)])
    stack = ", ".join(f"'{f}', c{i}" for i, f in enumerate(fields))
    return one_row.selectExpr(f"stack({len(fields)}, {stack}) AS (field, n_values)")


def row_groups(df: DataFrame, row_number: str = "row_number") -> DataFrame:
    """The duplicated keys of the row profile, written once for all their uses."""
    return written(duplicate_groups(duplicate_keys(df, DUPLICATE_KEYS, "row", row_number)), "duplicates")


def first_seen_errors(df: DataFrame, row_number: str = "row_number", groups: DataFrame | None = None) -> DataFrame:
    """A8 (row profile): ``row_number, error`` for each non-first row of a repeated key.

    The message names the normalised value and the row it was first seen in.  ``groups``
    is :func:`row_groups` of the same rows, where the caller has it.
    """
    keys = duplicate_keys(df, DUPLICATE_KEYS, "row", row_number)
    groups = row_groups(df, row_number) if groups is None else groups
    flagged = join_groups(keys, groups, ["field", "value"], "n").where(F.col("row_number") != F.col("first_row"))
    seq = F.lit(None).cast("int")
    word = F.lit(None).cast("string")
    for i, f in enumerate(DUPLICATE_KEYS):
        seq = F.when(F.col("field") == f, F.lit(i)).otherwise(seq)
        word = F.when(F.col("field") == f, F.lit(DUPLICATE_WORDS[f])).otherwise(word)
    label = F.concat(F.lit("Duplicate "), word)
    message = F.concat(F.col("code"), F.lit(" "), label, F.lit(": "), F.col("value"),
                       F.lit(" (also in row "), F.col("first_row").cast("string"), F.lit(")"))
    error = F.struct(seq.alias("seq"), F.col("field").alias("field"), label.alias("error_type"),
                     label.alias("label"), message.alias("message"), F.col("value").alias("value"))
    return flagged.select("row_number", error.alias("error"))
