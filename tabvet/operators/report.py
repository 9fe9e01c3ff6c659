"""Reports over a validation result.

Every report is an aggregate or a filter over the row result of
:func:`tabvet.operators.validate.validate`; :func:`validation_report` validates once
and derives them all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import written


def validity_summary(result: DataFrame) -> DataFrame:
    """``total_rows, valid_rows, invalid_rows`` in one pass."""
    return result.agg(F.count(F.lit(1)).alias("total_rows"),
                      F.count_if(F.col("valid")).alias("valid_rows"),
                      F.count_if(~F.col("valid")).alias("invalid_rows"))


def error_report(result: DataFrame) -> DataFrame:
    """One row per error with its field, type, message and stripped value."""
    # an outer explode: for a plain one Catalyst infers a filter on the array's size and copies
    # the whole rule set into it below the projections, which takes the driver's memory
    return (result.select("row_number", "code", F.explode_outer("errors").alias("e"))
                  .where(F.col("e").isNotNull())  # valid rows
                  .select("row_number", "code", F.col("e.seq").alias("seq"),
                          F.col("e.field").alias("field_name"),
                          F.col("e.error_type").alias("error_type"),
                          F.col("e.message").alias("error_message"),
                          F.col("e.value").alias("invalid_value")))


def positioned(errors: DataFrame) -> DataFrame:
    """R4 with ``pos``, the error's place in its row from 0, instead of ``seq``."""
    place = F.row_number().over(Window.partitionBy("row_number").orderBy("seq")) - 1  # a row's errors are few
    return errors.select("row_number", "code", place.cast("bigint").alias("pos"), "field_name", "error_type", "error_message", "invalid_value")


def error_counts(result: DataFrame) -> DataFrame:
    """A10: ``label, n, first_row, first_pos``; the label is the profile's count key.

    ``(first_row, first_pos)`` is where the label was first met (row, then the
    error's position in the row), which orders ties the way an insertion-ordered
    counter does (T1).  The two parts are a minimum and the position at that minimum, each a
    plain number, so the aggregate is a hash aggregate with partial (map-side) combining
    for any row number; a row has each label once, with its first place.
    """
    in_row = F.transform(F.array_distinct("labels"), lambda x: F.struct(  # a row's errors are few
        x.alias("label"), F.size(F.filter("labels", lambda y: y == x)).alias("n"), (F.array_position("labels", x) - 1).alias("pos")))
    exploded = result.select("row_number", F.col("errors.label").alias("labels")).select("row_number", F.explode(in_row).alias("x"))
    return (exploded.select("row_number", "x.label", "x.n", "x.pos")
                    .groupBy("label")
                    .agg(F.sum("n").alias("n"), F.min("row_number").alias("first_row"), F.min_by("pos", "row_number").cast("bigint").alias("first_pos")))


def error_counts_sorted(result: DataFrame) -> DataFrame:
    """Error counts, highest first, ties in first-seen order."""
    return error_counts(result).orderBy(F.desc("n"), "first_row", "first_pos")


def invalid_rows(result: DataFrame, n: int = 100) -> DataFrame:
    """The first ``n`` invalid rows in row order."""
    return result.where(~F.col("valid")).orderBy("row_number").limit(n)


def first_results(result: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` row results (10 in the row profile, 100 in bulk)."""
    return result.orderBy("row_number").limit(n)


def _rfind(s: Column, needle: str) -> Column:
    """0-based index of the last ``needle`` in ``s``, -1 when absent."""
    j = F.instr(F.reverse(s), needle[::-1])
    return F.when(j == 0, F.lit(-1)).otherwise(F.length(s) - j - F.lit(len(needle) - 1))


def parse_error_strings(errors: DataFrame, column: str = "error") -> DataFrame:
    """The reference's report built by re-reading rendered messages.

    Split on the first ``': '`` (messages without it are dropped); the field is
    the last word before it (``unknown`` without a space); a value is cut out
    only when the rest contains ``"': '"`` and ends with a quote.
    """
    e = F.col(column)
    pos = F.instr(e, ": ")
    head = F.expr(f"substring(`{column}`, 1, instr(`{column}`, ': ') - 1)")
    rest = F.expr(f"substring(`{column}`, instr(`{column}`, ': ') + 2)")
    field = F.when(F.instr(head, " ") > 0, F.substring_index(head, " ", -1)).otherwise(F.lit("unknown"))
    has_value = rest.contains("': '") & rest.endswith("'")
    cut = _rfind(rest, ": '")
    value_len = F.greatest(F.length(rest) - cut - F.lit(4), F.lit(0))
    keep = [c for c in errors.columns if c != column]
    staged = (errors.where(pos > 0)
                    .select(*keep, field.alias("field_name"),
                            rest.alias("rest_"), cut.alias("cut_"), value_len.alias("vlen_"),
                            has_value.alias("has_value_")))
    return staged.select(*keep, "field_name",
                         F.when(F.col("has_value_"), F.expr("substring(rest_, 1, cut_)"))
                          .otherwise(F.col("rest_")).alias("error_type"),
                         F.col("rest_").alias("error_message"),
                         F.when(F.col("has_value_"), F.expr("substring(rest_, cut_ + 4, vlen_)"))
                          .otherwise(F.lit("")).alias("invalid_value"))


def error_report_parsed(result: DataFrame) -> DataFrame:
    """R3 over a validation result: rendered messages of invalid rows, re-parsed."""
    msgs = (result.select("row_number", "code", F.posexplode("errors").alias("pos", "e"))
                  .select("row_number", "code", F.col("pos").cast("bigint").alias("pos"),
                          F.col("e.message").alias("error")))
    return parse_error_strings(msgs, "error")


@dataclass
class ValidationReport:
    """Everything one run answers, as DataFrames over one written result.

    ``results`` is R1, ``checked`` the rule results without duplicates and ``duplicates``
    the narrow table of duplicate errors (row profile); the summary and the counts are of both.
    """

    results: DataFrame
    summary: DataFrame
    error_counts: DataFrame
    duplicate_counts: DataFrame
    errors: DataFrame
    totals: dict[str, int]

    def has_errors(self) -> bool:
        return self.totals["errors"] > 0

    def metrics(self) -> DataFrame:
        """``metric, value``: the totals, and ``duplicate_`` and a field for each key."""
        spark = self.summary.sparkSession
        totals = spark.createDataFrame([(k, v) for k, v in self.totals.items()], "metric string, value long")
        return totals.unionByName(self.duplicate_counts.select(F.concat(F.lit("duplicate_"), F.col("field")).alias("metric"), F.col("n_values").alias("value")))


def _labels(checked: DataFrame, dups: DataFrame | None) -> DataFrame:
    """``label, row_number, seq`` of every error, from both tables."""
    own = checked.select("row_number", F.explode("errors").alias("e"))
    if dups is not None:
        own = own.unionByName(dups.select("row_number", F.explode("dup_errors").alias("e")))
    return own.select("row_number", "e")


def validation_report(df: DataFrame, ruleset=None, profile: str = "row", as_of: str = "2025-01-01",
                      row_number: str = "row_number") -> ValidationReport:
    """A11 in one validation: the rule results are written once, and observed while they are.

    In the row profile the duplicate errors stay a narrow table.  Error counts and the error report
    are unions of both; a row that breaks no rule but repeats a key is found by a join of
    that narrow table, so no error array is shuffled unless ``results`` is used and many
    rows are flagged.
    """
    from ..plans import rulesets as RS
    from . import duplicates as D
    from .validate import check_rows, duplicate_errors, merge_duplicates

    rules = ruleset if isinstance(ruleset, RS.RuleSet) else RS.get_ruleset(ruleset)
    observed = Observation()
    counted = check_rows(df, rules, profile, as_of, row_number).observe(
        observed, F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("valid")).alias("invalid"), F.coalesce(F.sum(F.size("errors").cast("long")), F.lit(0)).alias("errors"))
    checked = written(counted, "checked")
    got = observed.get
    invalid, n_errors, dups = got["invalid"], got["errors"], None
    if profile == "row":
        groups = D.row_groups(df, row_number)
        dups = duplicate_errors(df, row_number, groups)
        counts = D.count_groups(groups, D.DUPLICATE_KEYS)
        n_errors += dups.agg(F.sum(F.size("dup_errors").cast("long"))).first()[0] or 0
        invalid += dups.select("row_number").join(checked.where("valid").select("row_number"), "row_number").count()
    else:
        counts = D.duplicate_counts(df, profile="bulk", row_number=row_number)
    totals = {"total_rows": got["rows"], "valid_rows": got["rows"] - invalid, "invalid_rows": invalid, "errors": n_errors}
    spark, every = df.sparkSession, _labels(checked, dups)
    by_label = every.select(F.col("e.label").alias("label"), "row_number", F.col("e.seq").cast("long").alias("seq"))
    # a row's place among equal rows decides ties: the least seq of a label in its first row
    in_row = by_label.groupBy("label", "row_number").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"))
    sorted_counts = in_row.groupBy("label").agg(F.sum("n").alias("n"), F.min("row_number").alias("first_row"), F.min_by("seq", "row_number").alias("first_seq"))
    codes = checked.select("row_number", "code", F.explode("errors").alias("e"))
    if dups is not None:
        # a duplicate's message begins with the row's code
        words = dups.select("row_number", F.explode("dup_errors").alias("e"))
        codes = codes.unionByName(words.select("row_number", F.expr("substring(e.message, 1, instr(e.message, concat(' ', e.label, ': ', e.value, ' (also in row ')) - 1)").alias("code"), "e"))
    errors = codes.select("row_number", "code", F.col("e.seq").alias("seq"), F.col("e.field").alias("field_name"), F.col("e.error_type").alias("error_type"),
                          F.col("e.message").alias("error_message"), F.col("e.value").alias("invalid_value"))
    return ValidationReport(
        results=checked if dups is None else merge_duplicates(checked, dups),
        summary=spark.createDataFrame([(totals["total_rows"], totals["valid_rows"], invalid)], "total_rows long, valid_rows long, invalid_rows long"),
        error_counts=sorted_counts.orderBy(F.desc("n"), "first_row", "first_seq"),
        duplicate_counts=counts,
        errors=errors,
        totals=totals,
    )
