"""Row validation (R1), value-enhanced messages (R2) and rendering.

The whole rule set becomes **one projection**: every (column, rule) pair is a
``CASE WHEN`` that yields an error struct or NULL, and the row's errors are the
non-NULL entries of one array.  No Python runs per row, no shuffle happens
here.  The "row" profile additionally flags repeated keys (A8): one aggregation on
(field, value), whose errors stay a narrow table of their own
(:func:`duplicate_errors`); they are merged into the rows for R1's own output only.

Error struct: ``seq`` (order inside the row), ``field``, ``error_type`` (the
rule's own message), ``label`` (the key the profile counts by, A10),
``message`` (the rendered message, R5) and ``value`` (stripped cell, R2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.dates import parse_first
from ..functions.text import cell, pystrip
from ..plans import rulesets as RS
from ..session import written
from .skew import BROADCAST_BYTES, ROW_BYTES

ERROR_TYPE = ("struct<seq:int,field:string,error_type:string,label:string,"
              "message:string,value:string>")
PROFILES = ("row", "bulk")


def empty_errors() -> Column:
    return F.array().cast(f"array<{ERROR_TYPE}>")

SEQ_DUPLICATES = 0      # 0..3: the four duplicate keys (row profile)
SEQ_FIELDS = 10         # 10 + 2*pos (+1 for the second name error)


def _error(seq: int, field: str | Column, error_type: Column, label: Column, message: Column,
           value: Column) -> Column:
    """A one-element array holding the error when ``error_type`` is set, else empty.

    Concatenating these (instead of filtering NULLs out of one array with a
    higher-order function) keeps the projection inside whole-stage codegen.
    """
    f = F.lit(field) if isinstance(field, str) else field
    return F.when(error_type.isNotNull(), F.array(F.struct(
        F.lit(seq).alias("seq"), f.alias("field"), error_type.alias("error_type"),
        label.alias("label"), message.alias("message"), value.alias("value")))).otherwise(empty_errors())


def _head(spec: str | None, column: str) -> str | None:
    if spec == R.FIELD:
        return column
    if spec == R.LOWER:
        return column.lower()
    return spec


def _prefixed(head: str | None, body: Column) -> Column:
    return body if head is None else F.concat(F.lit(head + ": "), body)


def _quoted_value(body: Column, s: Column) -> Column:
    return F.concat(body, F.lit(": '"), s, F.lit("'"))


def code_column(ctx: R.RowContext) -> Column:
    """``row.get('code', 'N/A')``: the raw code, or N/A without that column."""
    return ctx.raw("code") if ctx.has("code") else F.lit("N/A")


def _rule_for(column: str, ruleset: RS.RuleSet):
    """(rule type, check, rendering) for a column, overrides applied."""
    rule_type = R.rule_type_of(column)
    override = RS.get_rule(ruleset.code, (rule_type or column).lower())
    if rule_type is None:
        if override is None or override.kind != "field":
            return None, None, None
        return column.lower(), override.builder, CUSTOM_RENDERING
    check, rendering = R.FIELD_RULES[rule_type]
    if override is not None and override.kind == "field":
        check = override.builder
    return rule_type, check, rendering


# how a registered rule for a column without a built-in rule is written
CUSTOM_RENDERING = R.Rendering(R.FIELD, True, R.FIELD, None)


def check_rows(df: DataFrame, ruleset: RS.RuleSet, profile: str = "row",
               as_of: str = "2025-01-01", row_number: str = "row_number") -> DataFrame:
    """Field and cross-field rules as narrow projections (no shuffle).

    Returns ``row_number, code, valid, errors`` (without the duplicate checks).
    Columns are checked in the frame's column order when their name is in the
    rule set's required list (case-folded, P9).  The work is staged in three
    projections -- stripped cells, rule messages, error structs -- so every
    rule expression is evaluated once even though several struct fields use it.
    """
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {PROFILES}")
    required = {f.lower() for f in ruleset.required}
    checked = [(pos, c) for pos, c in enumerate(df.columns)
               if c != row_number and c.lower() in required]

    # stage 1: stripped cells
    ctx0 = R.RowContext(df.columns, F.lit(as_of).cast("date"))
    code = code_column(ctx0)
    stage1 = df.select(F.col(row_number).alias("__rn"), code.alias("__code"), "*",
                       *[pystrip(cell(F.col(f"`{c}`"))).alias(f"__s{pos}") for pos, c in checked],
                       *[pystrip(ctx0.raw(cond.depends_on)).alias(f"__c{pos}") for pos, c in checked
                         if (cond := ruleset.conditional_for(c, R.rule_type_of(c))) is not None])
    # dates are parsed once here, so the date rules' CASE branches share them
    dated = [(pos, R.DATE_RULES[rt]) for pos, c in checked
             if (rt := R.rule_type_of(c)) in R.DATE_RULES]
    if dated:
        stage1 = stage1.select("*", *[parse_first(F.col(f"__s{pos}"), fmts).alias(f"__d{pos}")
                                      for pos, fmts in dated])

    # stage 2: one message column per (column, rule); NULL when the value passes
    ctx = R.RowContext(df.columns, F.lit(as_of).cast("date"))
    for pos, fmts in dated:
        ctx.parsed[(str(F.col(f"__s{pos}")), tuple(fmts))] = F.col(f"__d{pos}")
    msgs, plan = [], []
    for pos, c in checked:
        s, raw = F.col(f"__s{pos}"), cell(F.col(f"`{c}`"))
        rule_type, check, rendering = _rule_for(c, ruleset)
        conditional = ruleset.conditional_for(c, rule_type)
        if conditional is not None:
            req = F.when((s == F.lit("")) & conditional.holds(f"__c{pos}"), F.lit(conditional.message.format(c)))
        else:
            req = F.when(s == F.lit(""), F.lit(R.MSG_REQUIRED.format(c)))
        msgs.append(req.alias(f"__q{pos}"))
        if check is not None:
            msgs.append(F.when(s != F.lit(""), check(s, raw, ctx)).alias(f"__e{pos}"))
            second = R.ROW_SECOND_CHECK.get(rule_type) if profile == "row" else None
            if second is not None:
                msgs.append(F.when(s != F.lit(""), second(s, raw, ctx)).alias(f"__f{pos}"))
        plan.append((pos, c, rule_type, check, rendering))
    cross = [("address/city", R.address_city_error(ctx)),
             ("languagecode/countrycode", R.language_country_error(ctx))]
    cross += [(name, entry.builder(ctx)) for name, entry in RS.row_rules(ruleset.code)]
    msgs += [e.alias(f"__x{k}") for k, (_, e) in enumerate(cross)]
    stage2 = stage1.select("__rn", "__code", *[f"__s{pos}" for pos, _ in checked], *msgs)

    # stage 3: error structs, rendered for the profile
    code = F.col("__code")
    items: list[Column] = []
    for pos, c, rule_type, check, rendering in plan:
        seq = SEQ_FIELDS + 2 * pos
        s, q = F.col(f"__s{pos}"), F.col(f"__q{pos}")
        items.append(_error(seq, c, q, q, F.concat(code, F.lit(" "), q), F.lit("")))
        if check is None:
            continue
        e = F.col(f"__e{pos}")
        if profile == "row":
            if rendering.row_text is not None:
                body = F.lit(rendering.row_text)
            else:
                body = _quoted_value(e, s) if rendering.row_value else e
                body = _prefixed(_head(rendering.row_head, c), body)
            message = F.concat(code, F.lit(" "), body)
            label = _prefixed(_head(rendering.label_head, c), e)
        else:
            inner = _prefixed(_head(rendering.bulk_head, c), e)
            message = F.concat(code, F.lit(" "), F.lit(c + ": "), _quoted_value(inner, s))
            label = message
        items.append(_error(seq, c, e, label, message, s))
        if profile == "row" and R.ROW_SECOND_CHECK.get(rule_type) is not None:
            e2 = F.col(f"__f{pos}")
            body2 = _prefixed(_head(rendering.row_head, c), _quoted_value(e2, s))
            items.append(_error(seq + 1, c, e2, e2, F.concat(code, F.lit(" "), body2), s))
    for k, (name, _) in enumerate(cross):
        e = F.col(f"__x{k}")
        message = F.concat(code, F.lit(" "), e)
        items.append(_error(SEQ_FIELDS + 2 * len(df.columns) + k, name, e, e if profile == "row" else message, message, F.lit("")))
    errors = F.concat(*items)
    # validity from the message columns, not from the array: a filter on it
    # stays small when Catalyst pushes it below the projections
    message_cols = [c for c in stage2.columns if c[:3] in ("__q", "__e", "__f", "__x")]
    valid = F.coalesce(*[F.col(c) for c in message_cols]).isNull() if message_cols else F.lit(True)
    return stage2.select(F.col("__rn").alias("row_number"), code.alias("code"), valid.alias("valid"),
                         errors.alias("errors"))


def validate(df: DataFrame, ruleset: RS.RuleSet | str | None = None, profile: str = "row",
             as_of: str = "2025-01-01", row_number: str = "row_number",
             required: list[str] | None = None) -> DataFrame:
    """``row_number, code, valid, errors`` for every row.

    ``profile="row"`` adds the first-seen duplicate errors for email, username,
    personalid and idcardno ahead of the field errors; ``"bulk"`` does not.
    """
    if not isinstance(ruleset, RS.RuleSet):
        ruleset = RS.get_ruleset(ruleset, required)
    checked = check_rows(df, ruleset, profile, as_of, row_number)
    if profile == "row":
        return merge_duplicates(checked, duplicate_errors(df, row_number))
    return checked


def duplicate_errors(df: DataFrame, row_number: str = "row_number", groups: DataFrame | None = None) -> DataFrame:
    """``row_number, dup_errors`` of the rows that repeat a key, written: one narrow row each."""
    from .duplicates import first_seen_errors

    errors = first_seen_errors(df, row_number, groups).groupBy("row_number").agg(F.collect_list("error").alias("dup_errors"))  # at most 4 per row
    return written(errors, "first-seen")


def merge_duplicates(checked: DataFrame, dups: DataFrame) -> DataFrame:
    """R1 of the row profile: the rule results with the duplicate errors ahead of them.

    Few flagged rows (by their measured size) are broadcast, so the rule results are not
    shuffled; many are joined by a shuffle.
    """
    text = F.aggregate("dup_errors", F.lit(0), lambda n, e: n + F.octet_length(e["message"]) + F.octet_length(e["value"]) + 4 * ROW_BYTES)
    size = dups.agg(F.sum(text + ROW_BYTES)).first()[0] or 0
    dups = F.broadcast(dups) if size <= BROADCAST_BYTES else dups
    return (checked.join(dups, "row_number", "left")
            .select("row_number", "code",
                    (F.col("valid") & F.col("dup_errors").isNull()).alias("valid"),
                    F.when(F.col("dup_errors").isNull(), F.col("errors"))
                     .otherwise(F.concat(F.sort_array("dup_errors"), F.col("errors"))).alias("errors")))


def render(result: DataFrame, sep: str = " | ") -> DataFrame:
    """Flat form of a validation result: messages joined in row order."""
    return result.select(
        "row_number", "code", "valid",
        F.size("errors").cast("bigint").alias("n_errors"),
        F.array_join(F.col("errors.message"), sep).alias("errors"))


def enhance_with_value(df: DataFrame, columns: list[str], as_of: str = "2025-01-01",
                       regulation: str | None = None) -> DataFrame:
    """R2 on its own: ``row_number, field, enhanced`` (``{error}: '{value}'``) per failing cell."""
    ruleset = RS.get_ruleset(regulation)
    ctx = R.RowContext(df.columns, F.lit(as_of).cast("date"))
    items = []
    for c in columns:
        rule_type, check, _ = _rule_for(c, ruleset)
        if check is None:
            continue
        raw = cell(F.col(f"`{c}`"))
        s = pystrip(raw)
        e = F.when(s != F.lit(""), check(s, raw, ctx))
        items.append(F.when(e.isNotNull(), F.array(F.struct(F.lit(c).alias("field"),
                                                              _quoted_value(e, s).alias("enhanced"))))
                     .otherwise(F.array().cast("array<struct<field:string,enhanced:string>>")))
    return (df.select("row_number", F.explode(F.concat(*items)).alias("x"))
              .select("row_number", "x.field", "x.enhanced"))
