"""Registered queries: name -> (Spark callable, DuckDB oracle SQL or None).

Each Spark callable takes ``(spark, sf_dir)``, reads the driver's parquet
tables (or a fixture that Spark derives from them) in full and returns a
DataFrame whose columns are named exactly as in the oracle SQL.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from . import oracle as O
from .functions import rules as R
from .functions.text import cell, pystrip
from .operators import duplicates as D
from .operators import report as RP
from .operators.validate import render, validate
from .plans import rulesets as RS
from .session import DEFAULT_AS_OF

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, fn: Query, sql: str | None) -> None:
    QUERIES[name] = fn
    if sql is not None:
        ORACLE[name] = sql


def field_rule(df: DataFrame, column: str, rule_type: str, regulation: str | None = None,
               as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """One field rule over one column: ``row_number, value, error`` for failing rows."""
    ctx = R.RowContext(df.columns, F.lit(as_of).cast("date"))
    raw = cell(F.col(f"`{column}`"))
    s = pystrip(raw)
    check = R.FIELD_RULES[rule_type][0]
    override = RS.get_rule(regulation, rule_type)
    if override is not None and override.kind == "field":
        check = override.builder
    err = F.when(s != F.lit(""), check(s, raw, ctx))
    return df.select("row_number", s.alias("value"), err.alias("error")).where(F.col("error").isNotNull())


def cross_rule(df: DataFrame, builder, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    ctx = R.RowContext(df.columns, F.lit(as_of).cast("date"))
    return df.select("row_number", builder(ctx).alias("error")).where(F.col("error").isNotNull())


# ---------------------------------------------------------------- V3-V21
_SINGLE = [
    ("rule_email", "email", "email", None),
    ("rule_birthdate", "birthdate", "birthdate", None),
    ("rule_phone", "phone", "cellphone", None),
    ("rule_name", "firstname", "firstname", None),
    ("rule_regioncode", "regioncode", "regioncode", None),
    ("rule_provincecode", "provincecode", "provincecode", None),
    ("rule_province", "province", "province", None),
    ("rule_personalid", "personalid", "personalid", None),
    ("rule_personalid_pe", "personalid", "personalid", "PE"),
    ("rule_idcardno", "idcardno", "idcardno", None),
    ("rule_citizenship", "citizenship", "citizenship", None),
    ("rule_signupdate", "signupdate", "signupdate", None),
    ("rule_address_crlf", "address", "address", None),
    ("rule_countrycode", "countrycode", "countrycode", None),
    ("rule_zip", "zip", "zip", None),
    ("rule_zip_pe", "zip", "zip", "PE"),
    ("rule_language", "signuplanguagecode", "signuplanguagecode", None),
    ("rule_currency", "currencycode", "currencycode", None),
]
for _name, _rt, _col, _reg in _SINGLE:
    register(_name,
             (lambda rt, col, reg: lambda spark, sf: field_rule(fx.accounts(spark, sf), col, rt, reg))(_rt, _col, _reg),
             O.single_rule_sql(_rt, _col, _reg))


def _rule_name_length(spark, sf):
    acc = fx.accounts(spark, sf)
    s = pystrip(cell(F.col("lastname")))
    err = F.when(s != F.lit(""), R.name_length_error(s, s, None))
    return acc.select("row_number", s.alias("value"), err.alias("error")).where(F.col("error").isNotNull())


register("rule_name_length", _rule_name_length,
         f"{O.accounts_cte()}\nSELECT row_number, s_lastname AS value, error FROM (SELECT row_number, s_lastname, "
         f"CASE WHEN s_lastname <> '' THEN {O.r_name_len('s_lastname', None)} END AS error FROM a) AS t WHERE error IS NOT NULL")
# the first name column carries the 51-letter defect
register("rule_name_length_first", lambda spark, sf: _name_len_first(spark, sf),
         f"{O.accounts_cte()}\nSELECT row_number, s_firstname AS value, error FROM (SELECT row_number, s_firstname, "
         f"CASE WHEN s_firstname <> '' THEN {O.r_name_len('s_firstname', None)} END AS error FROM a) AS t WHERE error IS NOT NULL")


def _name_len_first(spark, sf):
    acc = fx.accounts(spark, sf)
    s = pystrip(cell(F.col("firstname")))
    err = F.when(s != F.lit(""), R.name_length_error(s, s, None))
    return acc.select("row_number", s.alias("value"), err.alias("error")).where(F.col("error").isNotNull())


# ---------------------------------------------------------------- V1, V2
def _rule_required(spark, sf):
    """V1: the required errors of the default rule set's validation."""
    from .operators.validate import check_rows

    errors = RP.error_report(check_rows(fx.accounts(spark, sf), RS.DEFAULT, "bulk"))
    missing = F.concat(F.col("field_name"), F.lit(R.MSG_REQUIRED.format("")))
    return errors.where(F.col("error_type") == missing).select("row_number", F.col("field_name").alias("field"), F.col("error_type").alias("error"))


register("rule_required", _rule_required,
         f"{O.accounts_cte()}\n" + "\nUNION ALL\n".join(
             f"SELECT row_number, {O.lit(c)} AS field, {O.lit(c + ' is required but missing')} AS error FROM a WHERE s_{c} = ''"
             for c in O.REQUIRED["DEFAULT"]))


def _rule_conditional_required(spark, sf):
    """V2: the conditional errors of Peru's validation."""
    from .operators.validate import check_rows

    errors = RP.error_report(check_rows(fx.accounts(spark, sf), RS.get_ruleset("PE"), "bulk"))
    return errors.where(F.col("error_type") == R.MSG_REQUIRED_ES.format("personalid")).select("row_number", F.col("error_type").alias("error"))


register("rule_conditional_required", _rule_conditional_required,
         f"{O.accounts_cte()}\nSELECT row_number, 'personalid is required for Spanish residents' AS error FROM a "
         f"WHERE s_personalid = '' AND upper(s_citizenship) = 'ES'")

# ---------------------------------------------------------------- X1-X3
register("cross_address_city", lambda spark, sf: cross_rule(fx.accounts(spark, sf), R.address_city_error),
         O.cross_rule_sql(O.x_address_city))
register("cross_language_country", lambda spark, sf: cross_rule(fx.accounts(spark, sf), R.language_country_error),
         O.cross_rule_sql(O.x_language_country))
register("cross_documents_pe", lambda spark, sf: cross_rule(fx.accounts(spark, sf), R.peru_documents_error),
         O.cross_rule_sql(O.x_documents_pe))


# ---------------------------------------------------------------- R1, R5
def _validated(regulation: str | None, profile: str) -> Query:
    def q(spark, sf):
        return render(validate(fx.accounts(spark, sf), regulation, profile))
    return q


for _reg, _key in [("CO", "co"), ("PE", "pe"), ("IMS", "basic"), (None, "default")]:
    register(f"validate_rows_{_key}", _validated(_reg, "row"), O.validate_rows_sql(_reg or "DEFAULT", "row"))
    register(f"validate_rows_{_key}_bulk", _validated(_reg, "bulk"), O.validate_rows_sql(_reg or "DEFAULT", "bulk"))


def _error_report(regulation: str | None, profile: str) -> Query:
    def q(spark, sf):
        return RP.positioned(RP.error_report(validate(fx.accounts(spark, sf), regulation, profile)))
    return q


register("error_report", _error_report("PE", "row"), O.error_report_sql("PE", "row"))
register("errors_rendered_row", _error_report("CO", "row"), O.error_report_sql("CO", "row"))
register("errors_rendered_bulk", _error_report("CO", "bulk"), O.error_report_sql("CO", "bulk"))


def _error_with_value(spark, sf):
    """R2: ``{error}: '{value}'`` for every field-rule error of the default rule set, one pass."""
    from .operators.validate import enhance_with_value

    acc = fx.accounts(spark, sf)
    cols = [c for c in acc.columns if c.lower() in {r.lower() for r in RS.DEFAULT_REQUIRED}
            and R.rule_type_of(c) is not None]
    return enhance_with_value(acc, cols)


def _error_with_value_sql() -> str:
    parts = []
    for c in O.ACC_COLS:
        rt = O.ALIASES.get(c.lower(), c.lower())
        if c.lower() not in {r.lower() for r in O.REQUIRED["DEFAULT"]} or rt not in O.RULES:
            continue
        e = f"(CASE WHEN s_{c} <> '' THEN {O.rule_sql(rt, c)} END)"
        parts.append(f"SELECT row_number, {O.lit(c)} AS field, {e} || ': ''' || s_{c} || '''' AS enhanced FROM a")
    return f"{O.accounts_cte()},\nx AS ({' UNION ALL '.join(parts)})\nSELECT * FROM x WHERE enhanced IS NOT NULL"


register("error_with_value", _error_with_value, _error_with_value_sql())


# ---------------------------------------------------------------- A9-A11, T1, T2, R3, R6
def _summary(regulation, profile):
    return lambda spark, sf: RP.validity_summary(validate(fx.accounts(spark, sf), regulation, profile))


register("validity_summary", _summary("PE", "row"), O.summary_sql("PE", "row"))
register("validity_summary_bulk", _summary("PE", "bulk"), O.summary_sql("PE", "bulk"))


def _counts(regulation, profile, sort=False):
    def q(spark, sf):
        res = validate(fx.accounts(spark, sf), regulation, profile)
        return RP.error_counts_sorted(res) if sort else RP.error_counts(res)
    return q


register("error_counts", _counts("PE", "row"), O.error_counts_sql("PE", "row"))
register("error_counts_bulk", _counts("PE", "bulk"), O.error_counts_sql("PE", "bulk"))
register("error_counts_sorted", _counts("CO", "row", sort=True), O.error_counts_sql("CO", "row"))


def _invalid_rows(spark, sf):
    return render(RP.invalid_rows(validate(fx.accounts(spark, sf), "PE", "bulk"), 100))


register("invalid_rows", _invalid_rows,
         f"SELECT * FROM ({O.validate_rows_sql('PE', 'bulk')}) AS v WHERE NOT valid ORDER BY row_number LIMIT 100")


def _first_results(spark, sf):
    return render(RP.first_results(validate(fx.accounts(spark, sf), "CO", "row"), 10))


register("first_results", _first_results,
         f"SELECT * FROM ({O.validate_rows_sql('CO', 'row')}) AS v ORDER BY row_number LIMIT 10")


def _report_parsed(spark, sf):
    return RP.error_report_parsed(validate(fx.accounts(spark, sf), "PE", "row"))


register("error_report_parsed", _report_parsed, None)  # oracle added below


# ---------------------------------------------------------------- A1-A8
def _dup_one(field: str) -> Query:
    def q(spark, sf):
        return D.duplicate_index(fx.accounts(spark, sf), [field], "row").select("value", "row_index")
    return q


def _dup_sql(field: str, lower: bool, blanks: bool) -> str:
    norm = f"lower({O.strip(field)})" if lower else O.strip(field)
    keep = f"{field} <> ''" if blanks else f"{norm} <> ''"
    return (f"{O.accounts_cte()},\nk AS (SELECT row_number, {norm} AS value FROM a WHERE {keep}),\n"
            f"g AS (SELECT value FROM k GROUP BY value HAVING count(*) > 1)\n"
            f"SELECT k.value AS value, k.row_number - 1 AS row_index FROM k JOIN g ON k.value = g.value")


register("dup_email", _dup_one("email"), _dup_sql("email", True, True))
register("dup_username", _dup_one("username"), _dup_sql("username", True, True))
register("dup_personalid", _dup_one("personalid"), _dup_sql("personalid", False, True))
register("dup_idcardno", _dup_one("idcardno"), _dup_sql("idcardno", False, True))
register("dup_any_field",
         lambda spark, sf: D.duplicate_index(fx.accounts(spark, sf), ["cellphone"], "bulk").select("value", "row_index"),
         _dup_sql("cellphone", True, False))


def _dup_all_sql(lower_all: bool) -> str:
    parts = []
    for f in D.DUPLICATE_KEYS:
        lower = lower_all or f in ("email", "username")
        norm = f"lower({O.strip(f)})" if lower else O.strip(f)
        keep = f"{norm} <> ''" if lower_all else f"{f} <> ''"
        parts.append(f"SELECT row_number, {O.lit(f)} AS field, {norm} AS value FROM a WHERE {keep}")
    return (f"{O.accounts_cte()},\nk AS ({' UNION ALL '.join(parts)}),\n"
            f"g AS (SELECT field, value, min(row_number) AS first_row FROM k GROUP BY field, value HAVING count(*) > 1)\n")


register("dup_index_all",
         lambda spark, sf: D.duplicate_index(fx.accounts(spark, sf), None, "bulk"),
         _dup_all_sql(True) + "SELECT k.field AS field, k.value AS value, k.row_number - 1 AS row_index "
                              "FROM k JOIN g ON k.field = g.field AND k.value = g.value")


def _dup_counts_sql(lower_all: bool) -> str:
    return (_dup_all_sql(lower_all) +
            "SELECT f.field AS field, CAST(count(g.value) AS BIGINT) AS n_values FROM "
            "(VALUES ('email'), ('username'), ('personalid'), ('idcardno')) AS f(field) "
            "LEFT JOIN g ON g.field = f.field GROUP BY f.field")


register("dup_counts", lambda spark, sf: D.duplicate_counts(fx.accounts(spark, sf), None, "bulk"),
         _dup_counts_sql(True))
register("dup_counts_row", lambda spark, sf: D.duplicate_counts(fx.accounts(spark, sf), None, "row"),
         _dup_counts_sql(False))


def _dup_first_seen(spark, sf):
    flagged = D.first_seen_errors(fx.accounts(spark, sf))
    return flagged.select("row_number", F.col("error.field").alias("field"), F.col("error.value").alias("value"),
                          F.col("error.message").alias("message"))


register("dup_first_seen", _dup_first_seen,
         _dup_all_sql(False) +
         ", w AS (SELECT k.row_number, k.field, k.value, g.first_row FROM k JOIN g ON k.field = g.field AND k.value = g.value "
         "WHERE k.row_number <> g.first_row)\n"
         "SELECT w.row_number AS row_number, w.field AS field, w.value AS value, a.code || ' Duplicate ' || "
         "CASE w.field WHEN 'email' THEN 'email' WHEN 'username' THEN 'username' WHEN 'personalid' THEN 'personal ID' "
         "ELSE 'ID card number' END || ': ' || w.value || ' (also in row ' || CAST(w.first_row AS VARCHAR) || ')' AS message "
         "FROM w JOIN a ON a.row_number = w.row_number")


# R3 oracle: the reference's re-parse of rendered messages, in SQL
def _parsed_sql() -> str:
    base = O.error_report_sql("PE", "row")
    head, _ = base.rsplit("\nSELECT row_number, code, CAST(i - 1 AS BIGINT) AS pos", 1)
    rest = "substr(error, instr(error, ': ') + 2)"
    cut = f"(length({rest}) - instr(reverse({rest}), ''' :') - 2)"
    has_value = f"(contains({rest}, ''': ''') AND suffix({rest}, ''''))"
    return (f"{head},\nm AS (SELECT row_number, code, CAST(i - 1 AS BIGINT) AS pos, e.message AS error FROM u)\n"
            f"SELECT row_number, code, pos, "
            f"CASE WHEN contains(substr(error, 1, instr(error, ': ') - 1), ' ') "
            f"THEN regexp_extract(substr(error, 1, instr(error, ': ') - 1), '[^ ]*$') ELSE 'unknown' END AS field_name, "
            f"CASE WHEN {has_value} THEN substr({rest}, 1, {cut}) ELSE {rest} END AS error_type, "
            f"{rest} AS error_message, "
            f"CASE WHEN {has_value} THEN substr({rest}, {cut} + 4, greatest(length({rest}) - {cut} - 4, 0)) ELSE '' END "
            f"AS invalid_value FROM m WHERE instr(error, ': ') > 0")


ORACLE["error_report_parsed"] = _parsed_sql()


# ---------------------------------------------------------------- P1-P9
from .operators import schema as SC  # noqa: E402
from .operators.rownum import number_rows  # noqa: E402

_P1_MAP = {"firstname": "first_name", "Email": "mail", "zip": "postcode"}
_P2_MAP = {"EMAIL": "mail", "FirstName": "given", "firstname": "ignored", "PHONE": "cellphone"}


register("rename_exact",
         lambda spark, sf: SC.rename_exact(fx.accounts(spark, sf), _P1_MAP)
         .select("row_number", "first_name", "email", "postcode"),
         f"WITH accounts AS ({fx.ACCOUNTS_SQL}) SELECT row_number, firstname AS first_name, email, zip AS postcode FROM accounts")
# PHONE -> cellphone collides with the existing cellphone column: the name
# keeps cellphone's position and takes phone's values
register("rename_ci",
         lambda spark, sf: SC.rename_ci(fx.accounts(spark, sf), _P2_MAP)
         .select("row_number", "given", "mail", "cellphone"),
         f"WITH accounts AS ({fx.ACCOUNTS_SQL}) SELECT row_number, firstname AS given, email AS mail, phone AS cellphone FROM accounts")
register("select_required",
         lambda spark, sf: SC.select_required(fx.accounts(spark, sf), ["CODE", "Email", "firstname", "lastname"],
                                              keep=["row_number"]),
         f"WITH accounts AS ({fx.ACCOUNTS_SQL}) SELECT row_number, code, firstname, lastname, email FROM accounts")


def _clean_sql(x: str) -> str:
    c = O.strip(x)
    c = f"(CASE WHEN starts_with({c}, chr(34)) AND ends_with({c}, chr(34)) THEN substr({c}, 2, length({c}) - 2) ELSE {c} END)"
    return f"(CASE WHEN starts_with({c}, chr(39)) AND ends_with({c}, chr(39)) THEN substr({c}, 2, length({c}) - 2) ELSE {c} END)"


def _norm_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[_\\s-]', '', 'g'), '^(customer|user|account|contact)', '')"


register("header_clean",
         lambda spark, sf: SC.header_catalog_clean(fx.headers(spark, sf)).select("file", "pos", "column_name", "cleaned"),
         f"WITH h AS ({fx.HEADERS_SQL}) SELECT file, pos, column_name, {_clean_sql('column_name')} AS cleaned FROM h")
register("header_normalize",
         lambda spark, sf: SC.header_catalog_clean(fx.headers(spark, sf)).select("file", "pos", "column_name", "normalized"),
         f"WITH h AS ({fx.HEADERS_SQL}) SELECT file, pos, column_name, {_norm_sql('column_name')} AS normalized FROM h")

_P5_REQUIRED = RS.IMS_REQUIRED + ["city"]
_P5_MAP = {"E-Mail": "email", "First_Name": "firstname", "Last Name": "lastname", "mail": "email"}


def _missing_sql() -> str:
    req = ", ".join(f"({i}, {O.lit(r)})" for i, r in enumerate(_P5_REQUIRED))
    maps = ", ".join(f"({O.lit(k.lower())}, {O.lit(v.lower())})" for k, v in _P5_MAP.items())
    return (f"WITH h AS ({fx.HEADERS_SQL}),\nc AS (SELECT file, lower({_clean_sql('column_name')}) AS n FROM h),\n"
            f"avail AS (SELECT file, n FROM c UNION SELECT c.file, m.tgt FROM c JOIN (VALUES {maps}) AS m(src, tgt) ON c.n = m.src),\n"
            f"files AS (SELECT DISTINCT file FROM h), req AS (SELECT * FROM (VALUES {req}) AS r(pos, field))\n"
            f"SELECT f.file AS file, r.pos AS pos, r.field AS field FROM files f, req r "
            f"WHERE NOT EXISTS (SELECT 1 FROM avail a WHERE a.file = f.file AND a.n = lower(r.field))")


register("missing_columns",
         lambda spark, sf: SC.missing_columns(fx.headers(spark, sf), _P5_REQUIRED, _P5_MAP),
         _missing_sql())
# P8 is order-dependent over each header; it is checked against a Python
# brute force in tests/test_schema.py (rows-only here)
register("suggest_mappings", lambda spark, sf: SC.suggest_mappings(fx.headers(spark, sf)), None)


def _row_numbering(spark, sf):
    fx.register_tables(spark, sf, ["lineitem"])
    li = spark.table("lineitem")   # the key has ties here: the other columns break them
    return number_rows(li, ["l_orderkey", "l_linenumber", *(c for c in li.columns if c not in ("l_orderkey", "l_linenumber"))])


register("row_numbering", _row_numbering,
         "SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, "
         "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS row_number FROM lineitem")


# ---------------------------------------------------------------- S1-S12
from .session import scratch_path  # noqa: E402
from .sources import csv as CSV  # noqa: E402
from .sources import dialect as DI  # noqa: E402
from .sources import sinks as SK  # noqa: E402

_ACC_SQL = f"WITH accounts AS ({fx.ACCOUNTS_SQL})"


def _write_accounts_csv(spark, sf, encoding="UTF-8", columns=None) -> str:
    acc = fx.accounts(spark, sf)
    if columns:
        acc = acc.select(*columns)
    path = scratch_path(spark, "accounts-csv")
    (acc.write.option("header", True).option("escape", '"').option("encoding", encoding)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def _roundtrip(spark, sf) -> DataFrame:
    df = CSV.read_delimited(spark, _write_accounts_csv(spark, sf), multi_line=True)
    return df.withColumn("row_number", F.col("row_number").cast("bigint"))


register("scan_csv_roundtrip", _roundtrip, f"{_ACC_SQL} SELECT * FROM accounts")

_RAGGED_COLS = ["row_number", "code", "firstname", "username", "zip", "gender"]


def _ragged(spark, sf):
    acc = fx.accounts(spark, sf)
    full = [F.col(c).cast("string") for c in _RAGGED_COLS]
    # defects planted by row: every tenth row loses its last three cells, the
    # next one carries an extra cell
    line = (F.when(F.col("row_number") % 10 == 0, F.concat_ws(",", *full[:3]))
             .when(F.col("row_number") % 10 == 1, F.concat_ws(",", *full, F.lit("EXTRA")))
             .otherwise(F.concat_ws(",", *full)))
    path = scratch_path(spark, "ragged")
    acc.select(line.alias("value")).write.text(path)
    df = CSV.read_delimited(spark, path, columns=_RAGGED_COLS, header=False, glob=None)
    return df.withColumn("row_number", F.col("row_number").cast("bigint"))


register("scan_csv_ragged", _ragged,
         f"{_ACC_SQL} SELECT row_number, code, firstname, "
         f"CASE WHEN row_number % 10 = 0 THEN '' ELSE username END AS username, "
         f"CASE WHEN row_number % 10 = 0 THEN '' ELSE zip END AS zip, "
         f"CASE WHEN row_number % 10 = 0 THEN '' ELSE gender END AS gender FROM accounts")

_ENC_COLS = ["row_number", "code", "firstname", "lastname"]


def _two_encodings(spark, sf) -> list[str]:
    return [_write_accounts_csv(spark, sf, "ISO-8859-1", _ENC_COLS), _write_accounts_csv(spark, sf, "UTF-8", _ENC_COLS)]


def _encoding_fallback(spark, sf):
    df = CSV.read_with_fallback(spark, _two_encodings(spark, sf))
    return df.withColumn("row_number", F.col("row_number").cast("bigint"))


register("scan_encoding_fallback", _encoding_fallback,
         f"{_ACC_SQL} SELECT row_number, code, firstname, lastname FROM accounts UNION ALL "
         f"SELECT row_number, code, firstname, lastname FROM accounts")


def _delim_select() -> str:
    counts = ", ".join(f"sum(length(line) - length(replace(line, {d}, ''))) AS c{i}"
                       for i, d in enumerate(["','", "';'", "chr(9)", "'|'"]))
    return ("SELECT file, CASE WHEN c0 >= c1 AND c0 >= c2 AND c0 >= c3 THEN ',' WHEN c1 >= c2 AND c1 >= c3 THEN ';' "
            f"WHEN c2 >= c3 THEN chr(9) ELSE '|' END AS delimiter FROM (SELECT file, {counts} FROM raw_lines "
            "WHERE line_no < 5 GROUP BY file) AS s0")


def _delim_sql() -> str:
    return f"WITH raw_lines AS ({fx.RAW_LINES_SQL})\n{_delim_select()}"


register("dialect_delimiter", lambda spark, sf: DI.detect_delimiter(fx.raw_lines(spark, sf)), _delim_sql())


def _encl_sql() -> str:
    w = lambda q: f"(starts_with(f, {q}) AND ends_with(f, {q}))"
    parts = []
    for i, q in enumerate(["chr(34)", "chr(39)"]):
        allw = f"len(list_filter(fields, lambda f: {w(q)}))"
        longw = f"len(list_filter(fields, lambda f: length(f) >= 2 AND {w(q)}))"
        parts.append(f"sum(CASE WHEN line_no = 0 THEN CASE WHEN {allw} = n THEN 10.0 ELSE {allw} / n END "
                     f"WHEN blank THEN 0.0 ELSE {longw} / n END) AS s{i}")
    neither = f"len(list_filter(fields, lambda f: NOT ({w('chr(34)')} OR {w('chr(39)')})))"
    parts.append(f"sum(CASE WHEN line_no = 0 OR blank THEN 0.0 ELSE {neither} / n END) AS s2")
    return (f"WITH raw_lines AS ({fx.RAW_LINES_SQL}),\nd AS ({_delim_select()}),\n"
            f"h AS (SELECT r.file, r.line_no, {O.strip('r.line')} = '' AS blank, "
            f"list_transform(string_split(r.line, d.delimiter), lambda f: {O.strip('f')}) AS fields FROM raw_lines r "
            f"JOIN d ON r.file = d.file WHERE r.line_no <= 5),\nh2 AS (SELECT *, len(fields) AS n FROM h),\n"
            f"sc AS (SELECT file, {', '.join(parts)} FROM h2 GROUP BY file)\n"
            "SELECT file, CASE WHEN s0 >= s1 AND s0 >= s2 THEN CASE WHEN s0 > 1 THEN chr(34) ELSE chr(34) END "
            "WHEN s1 >= s2 THEN CASE WHEN s1 > 1 THEN chr(39) ELSE chr(34) END "
            "ELSE CASE WHEN s2 > 1 THEN '' ELSE chr(34) END END AS enclosure FROM sc")


register("dialect_enclosure", lambda spark, sf: DI.detect_enclosure(fx.raw_lines(spark, sf)), _encl_sql())


def _preview(spark, sf):
    return CSV.preview(_roundtrip(spark, sf), 10)


register("preview_top_n", _preview, f"{_ACC_SQL} SELECT * FROM accounts ORDER BY row_number LIMIT 10")
register("row_count", lambda spark, sf: CSV.row_count(_roundtrip(spark, sf)),
         "SELECT count(*) AS rows FROM customer")


def _glob_filter(spark, sf):
    acc = fx.accounts(spark, sf)
    path = scratch_path(spark, "mixed")
    acc.write.option("header", True).option("escape", '"').csv(path)
    acc.write.mode("append").json(path)          # same folder, other extension
    return CSV.row_count(CSV.read_delimited(spark, path, multi_line=True))


register("scan_glob_filter", _glob_filter, "SELECT count(*) AS rows FROM customer")


# ---- files as numbered records: the fixture is cut into files of _FILE_ROWS rows, in
# row order by path, in a folder with a space in its name; every odd file has its
# columns the other way round, another delimiter and Latin-1
from .operators.files import preview_files, validate_files  # noqa: E402
from .sources import heads as HD  # noqa: E402
from .sources import records as REC  # noqa: E402

_FILE_ROWS = 400


def _write_numbered_files(spark, sf, columns: list[str], odd_columns: list[str]) -> str:
    acc = fx.accounts(spark, sf).withColumn("file_no", F.lpad(F.floor((F.col("row_number") - 1) / _FILE_ROWS).cast("string"), 9, "0"))
    path = scratch_path(spark, "numbered files")
    odd = F.col("file_no").cast("int") % 2 == 1
    for rows, names, sep, encoding in ((~odd, columns, ",", "UTF-8"), (odd, odd_columns, ";", "ISO-8859-1")):
        ordered = acc.where(rows).repartitionByRange("file_no").sortWithinPartitions("file_no", "row_number")
        (ordered.select(*names, "file_no").write.mode("append").partitionBy("file_no").option("header", True).option("quoteAll", True).option("escape", '"')
            .option("sep", sep).option("encoding", encoding).option("emptyValue", "")
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


_FILE_COLS = [c for c in O.ACC_COLS]
_PROFILE_COLS = ["code", "firstname", "lastname", "address", "city"]


def _scan_numbered(spark, sf):
    """P6 + S1: two headers, two dialects, line breaks in cells; one file kind lacks a column."""
    scan = REC.scan_files(spark, _write_numbered_files(spark, sf, _PROFILE_COLS, ["lastname", "firstname", "code", "address"]))
    return scan.rows.drop("file")


register("scan_files_numbered", _scan_numbered,
         f"{_ACC_SQL} SELECT row_number, code, firstname, lastname, address, "
         f"CASE WHEN ((row_number - 1) // {_FILE_ROWS}) % 2 = 0 THEN city ELSE '' END AS city FROM accounts")


def _files_to_report(spark, sf):
    """M1: files in, numbered in file order, error report out (row profile, PE)."""
    run = validate_files(spark, _write_numbered_files(spark, sf, _FILE_COLS, _FILE_COLS[::-1]), "PE", "row")
    return RP.positioned(run.report.errors)


register("files_to_report", _files_to_report, O.error_report_sql("PE", "row"))


def _file_no() -> F.Column:
    return F.regexp_extract("file", "file_no=([0-9]+)", 1)


def _file_profile(spark, sf):
    """One row a file."""
    path = _write_numbered_files(spark, sf, _PROFILE_COLS, _PROFILE_COLS[::-1])
    return REC.profile_files(spark, path).select(_file_no().alias("file_no"), "size_bytes", "records", "columns", "encoding", "delimiter", "enclosure", "line_breaks")


def _file_profile_sql() -> str:
    cells = ", ".join(_PROFILE_COLS)
    header = sum(len(c) + 3 for c in _PROFILE_COLS)     # quotes, and a delimiter or line end
    size = " + ".join(f"(CASE WHEN latin THEN length(replace({c}, chr(34), chr(34) || chr(34))) ELSE strlen(replace({c}, chr(34), chr(34) || chr(34))) END + 3)" for c in _PROFILE_COLS)
    breaks = " + ".join(f"length({c}) - length(replace({c}, chr(10), ''))" for c in _PROFILE_COLS)
    return (f"{_ACC_SQL}, f AS (SELECT (row_number - 1) // {_FILE_ROWS} AS n, n % 2 = 1 AS latin, {cells} FROM accounts)\n"
            f"SELECT lpad(n::VARCHAR, 9, '0') AS file_no, (sum({size}) + {header})::BIGINT AS size_bytes, count(*) AS records, {len(_PROFILE_COLS)} AS columns, "
            f"CASE WHEN any_value(latin) AND bool_or(strlen(firstname || lastname) <> length(firstname || lastname)) THEN 'latin-1' ELSE 'utf-8' END AS encoding, "
            f"CASE WHEN any_value(latin) THEN ';' ELSE ',' END AS delimiter, chr(34) AS enclosure, sum({breaks})::BIGINT AS line_breaks FROM f GROUP BY n")


register("file_profile", _file_profile, _file_profile_sql())


def _dialect_encoding(spark, sf):
    """S6, judged by each file's first bytes."""
    heads = HD.file_heads(spark, _write_numbered_files(spark, sf, _PROFILE_COLS, _PROFILE_COLS[::-1]))
    return heads.select(_file_no().alias("file_no"), "encoding")


register("dialect_encoding", _dialect_encoding, f"SELECT file_no, encoding FROM ({_file_profile_sql()}) AS p")


def _refused(spark, sf):
    """Records with more cells than their header, counted and kept apart."""
    full = [F.col(c).cast("string") for c in _RAGGED_COLS]
    rn = F.col("row_number")
    line = (F.when(rn % 10 == 0, F.concat_ws(",", *full[:3])).when(rn % 10 == 1, F.concat_ws(",", *full, F.lit("EXTRA"), F.lit('"a,b"'))).otherwise(F.concat_ws(",", *full)))
    line = F.when((rn - 1) % _FILE_ROWS == 0, F.concat(F.lit(",".join(_RAGGED_COLS) + "\n"), line)).otherwise(line)
    path = scratch_path(spark, "overlong")
    acc = fx.accounts(spark, sf).withColumn("file_no", F.lpad(F.floor((rn - 1) / _FILE_ROWS).cast("string"), 9, "0"))
    acc.repartitionByRange("file_no").sortWithinPartitions("file_no", "row_number").select(line.alias("value"), "file_no").write.partitionBy("file_no").text(path)
    return REC.scan_files(spark, path, glob=None).refused.select(_file_no().alias("file_no"), "row_number", "cells", "columns", "record")


register("scan_refused", _refused,
         f"{_ACC_SQL} SELECT lpad(((row_number - 1) // {_FILE_ROWS})::VARCHAR, 9, '0') AS file_no, row_number, 8 AS cells, 6 AS columns, "
         f"concat_ws(',', {', '.join(c + '::VARCHAR' for c in _RAGGED_COLS)}, 'EXTRA', '\"a,b\"') AS record FROM accounts WHERE row_number % 10 = 1")


def _dialect_heads(spark, sf):
    """S4-S6 from the first bytes of real files."""
    lines = fx.raw_lines(spark, sf)
    path = scratch_path(spark, "raw lines")
    lines.repartitionByRange("file").sortWithinPartitions("file", "line_no").select(F.col("line").alias("value"), F.col("file").alias("name")).write.partitionBy("name").text(path)
    heads = HD.file_heads(spark, path)
    return heads.select(F.regexp_extract("file", "name=([^/]+)", 1).alias("file"), "delimiter", "enclosure", "encoding")


register("dialect_heads", _dialect_heads,
         f"SELECT e.file AS file, d.delimiter AS delimiter, e.enclosure AS enclosure, 'utf-8' AS encoding FROM ({_delim_sql()}) AS d JOIN ({_encl_sql()}) AS e ON d.file = e.file")


def _preview_files(spark, sf):
    """First records with their file's dialect and the total."""
    return preview_files(REC.scan_files(spark, _write_numbered_files(spark, sf, _PROFILE_COLS, _PROFILE_COLS[::-1])), 10).drop("file")


register("preview_files", _preview_files,
         f"{_ACC_SQL} SELECT row_number, {', '.join(_PROFILE_COLS)}, 'utf-8' AS encoding, ',' AS delimiter, chr(34) AS enclosure, {len(_PROFILE_COLS)} AS n_columns, "
         f"(SELECT count(*) FROM accounts) AS total_rows FROM accounts ORDER BY row_number LIMIT 10")

_REPORT_SCHEMA = ("row_number bigint, code string, pos bigint, field_name string, error_type string, "
                  "error_message string, invalid_value string")


def _sink_json(spark, sf):
    rep = _error_report("PE", "row")(spark, sf)
    path = scratch_path(spark, "errors-json")
    SK.write_errors_json(rep, path)
    return spark.read.schema(_REPORT_SCHEMA).json(path)


register("sink_json_roundtrip", _sink_json, O.error_report_sql("PE", "row"))


def _sink_csv(spark, sf):
    rep = _error_report("PE", "bulk")(spark, sf)
    path = scratch_path(spark, "errors-csv")
    SK.write_errors_csv(rep, path)
    back = CSV.read_delimited(spark, path, multi_line=True)
    names = dict(zip(SK.CSV_HEADINGS, ["row_number", "code", "field_name", "error_type", "invalid_value",
                                       "error_message"]))
    return back.select(*[F.col(f"`{h}`").alias(n) for h, n in names.items()]) \
               .withColumn("row_number", F.col("row_number").cast("bigint"))


register("sink_csv_roundtrip", _sink_csv,
         O.error_report_sql("PE", "bulk").replace(
             "SELECT row_number, code, CAST(i - 1 AS BIGINT) AS pos, e.field AS field_name",
             "SELECT row_number, code, e.field AS field_name"))


# ---------------------------------------------------------------- ST1, ST2
from .streaming import stream as ST  # noqa: E402


def _stream_validate(spark, sf):
    schema = spark.read.parquet(f"{sf}/customer.parquet").schema
    (spark.readStream.schema(schema).option("pathGlobFilter", "customer.parquet").parquet(sf)
          .createOrReplaceTempView("customer"))
    acc = spark.sql(fx.ACCOUNTS_SQL)                     # the fixture, as a stream
    out = ST.run_to_table(ST.validate_stream(acc, "PE"), "stream-validate")
    res = spark.read.parquet(out)
    return render(res)


register("stream_validate", _stream_validate, O.validate_rows_sql("PE", "bulk"))


def _stream_first_seen(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = ST.first_seen_stream(events, "user_id", "event_id", "events-first-seen")
    return spark.read.parquet(out).select("event_id", "user_id", "first_id")


register("stream_first_seen", _stream_first_seen,
         "SELECT event_id, user_id, first_id FROM (SELECT event_id, user_id, min(event_id) OVER (PARTITION BY user_id) "
         "AS first_id FROM events) AS e WHERE event_id <> first_id")


# ---------------------------------------------------------------- U1-U3, U5, U7, A11
def _override(spark, sf):
    acc = fx.accounts(spark, sf)
    ctx = R.RowContext(acc.columns, F.lit(DEFAULT_AS_OF).cast("date"))
    raw = cell(F.col("zip"))
    s = pystrip(raw)
    default = F.when(s != F.lit(""), R.FIELD_RULES["zip"][0](s, raw, ctx))
    over = F.when(s != F.lit(""), RS.get_rule("PE", "zip").builder(s, raw, ctx))
    return (acc.select("row_number", default.alias("default_error"), over.alias("override_error"))
               .where(F.col("default_error").isNotNull() | F.col("override_error").isNotNull()))


register("ruleset_override", _override,
         f"{O.accounts_cte()}\nSELECT * FROM (SELECT row_number, "
         f"CASE WHEN s_zip <> '' THEN {O.r_zip('s_zip', None)} END AS default_error, "
         f"CASE WHEN s_zip <> '' THEN {O.r_zip_pe('s_zip', None)} END AS override_error FROM a) AS t "
         f"WHERE default_error IS NOT NULL OR override_error IS NOT NULL")


def _conditional(spark, sf):
    acc = fx.accounts(spark, sf)
    dep = RS.get_ruleset("PE").conditional_for("personalid", None).depends_on
    out = field_rule(acc, "personalid", "personalid", "PE")
    return out.join(acc.select("row_number", F.col(dep).alias("dependency_value")), "row_number")


register("ruleset_conditional", _conditional,
         f"{O.accounts_cte()}\nSELECT row_number, s_personalid AS value, error, citizenship AS dependency_value FROM "
         f"(SELECT row_number, s_personalid, citizenship, CASE WHEN s_personalid <> '' THEN "
         f"{O.r_personalid_pe('s_personalid', O.raw_ctx)} END AS error FROM a) AS t WHERE error IS NOT NULL")


def _conditional_own(spark, sf):
    """A user's own conditions, as data: required where SQL over another field holds."""
    RS.define_ruleset("CX", "Conditions", ["code", "city", "languagecode", "email"], conditional={
        "city": RS.Conditional("citizenship", "lower({value}) IN ('pe', 'es') AND length({value}) = 2", "{} is required for PE and ES"),
        "LanguageCode": RS.Conditional("gender", lambda g: g == "F"),
        "email": RS.Conditional("no_such_column", "{value} <> ''")})
    try:
        return render(validate(fx.accounts(spark, sf), "CX", "bulk"))
    finally:
        RS.remove_ruleset("CX")


def _conditional_own_sql() -> str:
    """Email is never required (its condition's column is absent) but is still checked where it is given."""
    req = lambda c, cond, msg: f"CASE WHEN s_{c} = '' AND {cond} THEN code || ' {c} {msg}' END"
    msgs = ["CASE WHEN s_code = '' THEN code || ' code is required but missing' END",
            f"CASE WHEN s_email <> '' THEN code || ' email: ' || {O.rule_sql('email', 'email')} || {O.lit(chr(58) + chr(32) + chr(39))} || s_email || chr(39) END",
            req("city", "lower(s_citizenship) IN ('pe', 'es') AND length(s_citizenship) = 2", "is required for PE and ES"),
            req("languagecode", "s_gender = 'F'", "is required but missing"),
            f"code || ' ' || {O.x_address_city(O.raw_ctx)}", f"code || ' ' || {O.x_language_country(O.raw_ctx)}"]
    n = " + ".join(f"CAST(({m}) IS NOT NULL AS INTEGER)" for m in msgs)
    return (f"{O.accounts_cte()}\nSELECT row_number, code, ({n}) = 0 AS valid, CAST({n} AS BIGINT) AS n_errors, "
            f"concat_ws(' | ', {', '.join(msgs)}) AS errors FROM a")


register("ruleset_conditional_own", _conditional_own, _conditional_own_sql())

_GENDER_MSG = "Gender must be M or F"


def _gender_rule(s, raw, ctx):
    return F.when(~s.isin("M", "F"), F.lit(_GENDER_MSG))


def _custom(spark, sf):
    RS.define_ruleset("GX", "Gender check", ["code", "gender"])
    RS.register_rule("GX", "gender", _gender_rule)
    try:
        return render(validate(fx.accounts(spark, sf), "GX", "bulk"))   # the rules are in the plan now
    finally:
        RS.remove_ruleset("GX")


def _custom_sql() -> str:
    req = lambda c: f"CASE WHEN s_{c} = '' THEN code || {O.lit(' ' + c + ' is required but missing')} END"
    rule = (f"CASE WHEN s_gender <> '' AND s_gender NOT IN ('M', 'F') THEN code || ' gender: ' || "
            f"{O.lit(_GENDER_MSG)} || ': ''' || s_gender || '''' END")
    msgs = [req("code"), req("gender"), rule, f"code || ' ' || {O.x_address_city(O.raw_ctx)}",
            f"code || ' ' || {O.x_language_country(O.raw_ctx)}"]
    n = " + ".join(f"CAST(({m}) IS NOT NULL AS INTEGER)" for m in msgs)
    return (f"{O.accounts_cte()}\nSELECT row_number, code, ({n}) = 0 AS valid, CAST({n} AS BIGINT) AS n_errors, "
            f"concat_ws(' | ', {', '.join(msgs)}) AS errors FROM a")


register("ruleset_custom", _custom, _custom_sql())


def _udf_row_check(row: dict) -> list:
    errors = []
    if len(row["code"].strip()) > 50:
        errors.append("code longer than 50")
    if row["gender"].strip() not in ("M", "F"):
        errors.append("gender not one of M, F")
    return errors


def _validate_udf(spark, sf):
    from .operators.udf import validate_with_function

    acc = fx.accounts(spark, sf).select("row_number", "code", "gender")
    return validate_with_function(acc, _udf_row_check)


register("validate_with_udf", _validate_udf,
         f"{O.accounts_cte()}\nSELECT row_number, valid, n_errors, errors FROM (SELECT row_number, "
         f"(length(s_code) > 50)::INT + (s_gender NOT IN ('M', 'F'))::INT AS n, n = 0 AS valid, CAST(n AS BIGINT) AS n_errors, "
         f"concat_ws(' | ', CASE WHEN length(s_code) > 50 THEN 'code longer than 50' END, "
         f"CASE WHEN s_gender NOT IN ('M', 'F') THEN 'gender not one of M, F' END) AS errors FROM a) AS t")


def _declared(spark, sf):
    from .plans.constraints import check_declared

    return check_declared(fx.accounts(spark, sf), "CO")


def _declared_sql() -> str:
    parts = []
    for field, spec in RS.CO_DECLARED.items():
        if field not in O.ACC_COLS:
            continue
        s = f"s_{field}"
        for kind in ["required", "min_length", "max_length", "pattern", "values", "min_age"]:
            if kind not in spec:
                continue
            arg = spec[kind]
            if kind == "required":
                if not arg or spec.get("conditional"):
                    continue
                cond, msg = f"{s} = ''", f"{field} is required"
            elif kind == "min_length":
                cond, msg = f"{s} <> '' AND length({s}) < {arg}", f"{field} shorter than {arg}"
            elif kind == "max_length":
                cond, msg = f"{s} <> '' AND length({s}) > {arg}", f"{field} longer than {arg}"
            elif kind == "pattern":
                cond, msg = f"{s} <> '' AND NOT regexp_matches({s}, {O.lit(arg)})", f"{field} does not match {arg}"
            elif kind == "values":
                cond = f"{s} <> '' AND {s} NOT IN ({', '.join(O.lit(v) for v in arg)})"
                msg = f"{field} not one of {', '.join(arg)}"
            else:
                b = f"coalesce({O._parse(s, 'dmy')}, {O._parse(s, 'mdy')})"
                cond = f"{s} <> '' AND {b} IS NOT NULL AND date_sub('year', {b}, {O.AS_OF}) < {arg}"
                msg = f"{field} younger than {arg}"
            parts.append(f"SELECT row_number, {O.lit(field)} AS field, {O.lit(kind)} AS \"constraint\", "
                         f"{O.lit(msg)} AS error FROM a WHERE {cond}")
    return f"{O.accounts_cte()}\n" + "\nUNION ALL\n".join(parts)


register("declared_constraints", _declared, _declared_sql())


def _report(spark, sf):
    """One run's totals in long form."""
    return RP.validation_report(fx.accounts(spark, sf), "PE", "row").metrics()


def _report_sql_simple() -> str:
    summ = O.summary_sql("PE", "row")
    dup = _dup_counts_sql(False)
    errs = O.validate_rows_sql("PE", "row")
    return (f"SELECT 'total_rows' AS metric, total_rows AS value FROM ({summ}) AS s UNION ALL "
            f"SELECT 'valid_rows', valid_rows FROM ({summ}) AS s UNION ALL "
            f"SELECT 'invalid_rows', invalid_rows FROM ({summ}) AS s UNION ALL "
            f"SELECT 'duplicate_' || field, n_values FROM ({dup}) AS d UNION ALL "
            f"SELECT 'errors', CAST(sum(n_errors) AS BIGINT) FROM ({errs}) AS v")


register("validation_report", _report, _report_sql_simple())


# ---------------------------------------------------------------- K1
def _scalar_strip(spark, sf):
    acc = fx.accounts(spark, sf)
    return acc.select("row_number", *[pystrip(cell(F.col(f"`{c}`"))).alias(c) for c in acc.columns if c != "row_number"])


register("scalar_strip", _scalar_strip,
         f"{O.accounts_cte()}\nSELECT row_number, {', '.join(f's_{c} AS {c}' for c in O.ACC_COLS)} FROM a")
