"""DuckDB oracle SQL for the registered queries (correctness gate).

Written on its own from the rule semantics, as SQL text, so that a mistake in
the Spark Column builders does not repeat itself here.  Every query starts
from the same fixture text as the Spark side (``tabvet.fixtures``).
"""

from __future__ import annotations

from . import fixtures as fx

AS_OF = "DATE '2025-01-01'"

# Fixed value: Python's str.strip() whitespace, as code points.
_WS_POINTS = ([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760] + list(range(8192, 8203))
              + [8232, 8233, 8239, 8287, 12288])
WS = "||".join(f"chr({c})" for c in _WS_POINTS)

ACC_COLS = ["code", "firstname", "lastname", "email", "birthdate", "address", "city", "cellphone",
            "phone", "countrycode", "languagecode", "signuplanguagecode", "currencycode", "username",
            "zip", "signupdate", "gender", "citizenship", "regioncode", "provincecode", "province",
            "personalid", "idcardno", "passportid", "DRIVERLICENSENO", "birthcity",
            "birthcountrycode", "password"]

REQUIRED = {
    "CO": ["code", "firstname", "lastname", "email", "birthdate", "address", "city", "countrycode",
           "zip", "cellphone", "gender", "username", "citizenship", "regioncode", "provincecode",
           "province", "personalid", "idcardno", "birthcity", "birthcountrycode"],
    "PE": ["code", "firstname", "lastname", "email", "birthdate", "address", "city", "countrycode",
           "zip", "username", "citizenship", "provincecode", "province", "personalid", "idcardno",
           "regioncode"],
    "IMS": ["code", "email", "firstname", "lastname"],
    "DEFAULT": ["code", "firstname", "lastname", "email", "birthdate", "address", "city", "phone",
                "cellphone", "countrycode", "signuplanguagecode", "currencycode", "username", "zip",
                "signupdate", "password"],
}


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def s_(c: str) -> str:
    return f's_{c}'


def accounts_cte() -> str:
    stripped = ", ".join(f"{strip(c)} AS {s_(c)}" for c in ACC_COLS)
    return f"WITH accounts AS ({fx.ACCOUNTS_SQL}),\na AS (SELECT *, {stripped} FROM accounts)"


# ---------------------------------------------------------------- date parsing
_D = "(3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9])"
_M = "(1[0-2]|0[1-9]|[1-9])"


def _parse(s: str, fmt: str) -> str:
    if fmt == "dmy":
        guard, f, year_ok = f"^{_D}/{_M}/[0-9]{{4}}$", "%d/%m/%Y", f"NOT suffix({s}, '0000')"
    elif fmt == "mdy":
        guard, f, year_ok = f"^{_M}/{_D}/[0-9]{{4}}$", "%m/%d/%Y", f"NOT suffix({s}, '0000')"
    else:
        guard, f, year_ok = f"^[0-9]{{4}}-{_M}-{_D}$", "%Y-%m-%d", f"NOT prefix({s}, '0000')"
    return (f"CASE WHEN regexp_matches({s}, {lit(guard)}) AND {year_ok} "
            f"THEN CAST(try_strptime(replace({s}, ' ', ''), {lit(f)}) AS DATE) END")


# ---------------------------------------------------------------- field rules
# Patterns of the field rules.
PHONE_RE = r"^\+?\d[\d\s\-\(\)]{8,20}$"
TWO_UPPER_RE = "^[A-Z]{2}$"
ZIP_RE = r"^[a-zA-Z0-9\s\-]{3,10}$"
TWO_LOWER_RE = "^[a-z]{2}$"
THREE_UPPER_RE = "^[A-Z]{3}$"
EMAIL_RE = r"^[a-zA-Z0-9._%+-áéíóúñÁÉÍÓÚÑ$]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
NAME_RE = r"^[a-zA-ZáéíóúñÁÉÍÓÚÑ\s\-\'\.]+$"
PID_RE = r"^[A-Za-z0-9\-\s]+$"
CODE_RE = r"^[A-Za-z0-9\-_]{1,10}$"


def _nm(cond: str, msg: str) -> str:
    return f"WHEN {cond} THEN {lit(msg)}"


def r_email(s, ctx):
    return (f"CASE {_nm(f'NOT contains({s}, {lit('@')})', 'Email missing @ symbol')} "
            f"{_nm(f'NOT regexp_matches({s}, {lit(EMAIL_RE)})', 'Email has invalid format')} "
            f"{_nm(f'split_part(lower({s}), {lit('@')}, 2) IN {DISPOSABLE}', 'Disposable email addresses are not allowed')} END")


def r_birthdate(s, ctx):
    b = f"coalesce({_parse(s, 'dmy')}, {_parse(s, 'mdy')})"
    age = f"date_sub('year', {b}, {AS_OF})"
    return (f"CASE WHEN {b} IS NULL THEN 'Invalid birthdate format' "
            f"WHEN {b} > {AS_OF} THEN 'Birthdate is in the future' "
            f"WHEN {age} < 18 THEN 'Account holder is underage (age: ' || CAST({age} AS VARCHAR) || ')' END")


def r_phone(s, ctx):
    return f"CASE {_nm(f'NOT regexp_matches({s}, {lit(PHONE_RE)})', 'Phone number has invalid format')} END"


def r_name(s, ctx):
    return (f"CASE {_nm(f'length({s}) > 50', 'Name too long (max 50 characters)')} "
            f"{_nm(f'NOT regexp_matches({s}, {lit(NAME_RE)})', 'Name contains invalid characters')} END")


def r_name_len(s, ctx):
    return f"CASE {_nm(f'length({s}) > 50', 'Name too long (max 50 characters)')} END"


def r_regioncode(s, ctx):
    return f"CASE {_nm(f'NOT regexp_matches({s}, {lit(CODE_RE)})', 'Region code contains invalid characters or is too long')} END"


def r_provincecode(s, ctx):
    return f"CASE {_nm(f'NOT regexp_matches({s}, {lit(CODE_RE)})', 'Province code contains invalid characters or is too long')} END"


def r_province(s, ctx):
    return (f"CASE {_nm(f'length({s}) < 2', 'Province name too short')} "
            f"{_nm(f'length({s}) > 50', 'Province name too long')} "
            f"{_nm(f'NOT regexp_matches({s}, {lit(NAME_RE)})', 'Province contains invalid characters')} END")


def _id_rule(s, short, long_, chars):
    return (f"CASE {_nm(f'length({s}) < 5', short)} {_nm(f'length({s}) > 20', long_)} "
            f"{_nm(f'NOT regexp_matches({s}, {lit(PID_RE)})', chars)} END")


def r_personalid(s, ctx):
    return _id_rule(s, "Personal ID too short", "Personal ID too long", "Personal ID contains invalid characters")


def r_personalid_pe(s, ctx):
    cit = ctx("citizenship")
    spanish = f"upper({strip(cit)}) = 'ES'"
    ok_es = f"(regexp_matches(upper({s}), '^\\d{{8}}[A-Z]$') OR regexp_matches(upper({s}), '^[XYZ]\\d{{7}}[A-Z]$'))"
    return (f"CASE WHEN {cit} = '' THEN 'Citizenship is required for PersonalID validation' "
            f"WHEN {spanish} THEN CASE WHEN {ok_es} THEN NULL ELSE "
            f"{lit('Invalid Spanish ID format. Must be DNI (8 digits + letter) or NIE (X/Y/Z + 7 digits + letter)')} END "
            f"{_nm(f'length({s}) < 5', 'PersonalID is too short (minimum 5 characters)')} "
            f"{_nm(f'length({s}) > 20', 'PersonalID is too long (maximum 20 characters)')} "
            f"{_nm(f'NOT regexp_matches({s}, {lit(PID_RE)})', 'PersonalID contains invalid characters')} END")


def r_idcardno(s, ctx):
    return _id_rule(s, "ID card number too short", "ID card number too long", "ID card number contains invalid characters")


def r_citizenship(s, ctx):
    return f"CASE {_nm(f'NOT regexp_matches(upper({s}), {lit(TWO_UPPER_RE)})', 'Citizenship must be 2 uppercase letters')} END"


def r_signupdate(s, ctx):
    d = f"coalesce({_parse(s, 'dmy')}, {_parse(s, 'mdy')}, {_parse(s, 'ymd')})"
    return (f"CASE WHEN {d} IS NULL THEN 'Invalid signup date format' "
            f"WHEN {d} > {AS_OF} THEN 'Signup date is in the future' END")


def r_address(s, ctx, raw=None):
    return (f"CASE WHEN contains({raw}, chr(13)) OR contains({raw}, chr(10)) "
            f"THEN 'Contains line breaks (potential CRLF injection)' END")


def r_countrycode(s, ctx):
    return f"CASE {_nm(f'NOT regexp_matches(upper({s}), {lit(TWO_UPPER_RE)})', 'Country code must be 2 uppercase letters')} END"


def r_zip(s, ctx):
    return f"CASE {_nm(f'NOT regexp_matches({s}, {lit(ZIP_RE)})', 'Zip code has invalid format')} END"


def r_zip_pe(s, ctx):
    ok = (f"regexp_matches(upper({s}), '^LIMA\\d{{2}}$') OR regexp_matches({s}, '^\\d{{5}}$') "
          f"OR regexp_matches({s}, '^\\d{{6}}$')")
    return f"CASE WHEN {ok} THEN NULL ELSE 'Peru zip code must be 5 digits, 6 digits, or LIMA format (LIMAxx)' END"


def r_language(s, ctx):
    return f"CASE {_nm(f'NOT regexp_matches(lower({s}), {lit(TWO_LOWER_RE)})', 'Language code must be 2 lowercase letters')} END"


def r_currency(s, ctx):
    return f"CASE {_nm(f'NOT regexp_matches(upper({s}), {lit(THREE_UPPER_RE)})', 'Not a valid format (should be 3 uppercase letters)')} END"


# ---------------------------------------------------------------- cross rules
def x_address_city(ctx):
    a, c = ctx("address"), ctx("city")
    return (f"CASE WHEN {a} <> '' AND {c} = '' THEN 'Address provided but city is missing' "
            f"WHEN {c} <> '' AND {a} = '' THEN 'City provided but address is missing' END")


LANG = {"es": ["ES", "MX", "AR", "CO", "PE", "CL", "VE"], "en": ["US", "GB", "CA", "AU", "NZ"],
        "fr": ["FR", "CA", "BE", "CH"], "de": ["DE", "AT", "CH"], "it": ["IT", "CH"], "pt": ["PT", "BR"]}


def x_language_country(ctx):
    lr, cr = ctx("languagecode"), ctx("countrycode")
    l_, c_ = f"lower({strip(lr)})", f"upper({strip(cr)})"
    bad = " OR ".join(f"({l_} = {lit(k)} AND {c_} NOT IN ({', '.join(lit(x) for x in v)}))" for k, v in LANG.items())
    return (f"CASE WHEN {lr} <> '' AND {cr} <> '' AND ({bad}) THEN "
            f"'Language ''' || {l_} || ''' not typically used in country ''' || {c_} || '''' END")


DOCS_MSG = "Non-residents must provide at least one document: ID card, passport, driver's license, or personal ID"
DISPOSABLE = "('tempmail.org', '10minutemail.com', 'guerrillamail.com')"


def x_documents_pe(ctx):
    cit = ctx("citizenship")
    blanks = " AND ".join(f"{strip(ctx(d))} = ''" for d in ["idcardno", "passportid", "DRIVERLICENSENO", "personalid"])
    return (f"CASE WHEN {cit} <> '' AND upper({strip(cit)}) <> 'ES' AND {blanks} THEN "
            f"{lit(DOCS_MSG)} END")


def raw_ctx(name: str) -> str:
    return name if name in ACC_COLS else "''"


# rule type -> (sql, row_head, row_value, label_head, bulk_head, row_text); F=column, L=lower(column)
RULES = {
    "email": (r_email, None, True, None, None, None),
    "birthdate": (r_birthdate, None, False, "Birthdate", "Birthdate", "Invalid birthdate"),
    "phone": (r_phone, "$F", True, "$F", "$L", None),
    "firstname": (r_name, "firstname", True, None, None, None),
    "lastname": (r_name, "lastname", True, None, None, None),
    "regioncode": (r_regioncode, "regioncode", False, "regioncode", "regioncode", None),
    "provincecode": (r_provincecode, "provincecode", False, "provincecode", "provincecode", None),
    "province": (r_province, "province", False, "province", "province", None),
    "personalid": (r_personalid, "personalid", True, "personalid", "personalid", None),
    "idcardno": (r_idcardno, "idcardno", True, "idcardno", "idcardno", None),
    "citizenship": (r_citizenship, "citizenship", False, "citizenship", "citizenship", None),
    "signupdate": (r_signupdate, "signupdate", False, "signupdate", "signupdate", None),
    "address": (r_address, "address", False, "address", "address", None),
    "countrycode": (r_countrycode, "countrycode", False, "countrycode", "countrycode", None),
    "zip": (r_zip, "$F", False, "$F", "$L", None),
    "signuplanguagecode": (r_language, "signuplanguagecode", False, "signuplanguagecode", "signuplanguagecode", None),
    "currencycode": (r_currency, "currencycode", False, "currencycode", "currencycode", None),
}
ALIASES = {"cellphone": "phone", "zipcode": "zip", "postalcode": "zip", "postcode": "zip"}
PE_OVERRIDES = {"personalid": r_personalid_pe, "zip": r_zip_pe}


def rule_sql(rule_type: str, col: str, regulation: str | None = None) -> str:
    fn = RULES[rule_type][0]
    if regulation == "PE" and rule_type in PE_OVERRIDES:
        fn = PE_OVERRIDES[rule_type]
    if rule_type == "address":
        return r_address(s_(col), raw_ctx, raw=col)
    return fn(s_(col), raw_ctx)


def _head(h, col):
    return {"$F": col, "$L": col.lower()}.get(h, h) if h else None


def _pre(h, body):
    return body if h is None else f"{lit(h + ': ')} || {body}"


def error_items(regulation: str, profile: str) -> list[dict]:
    """Ordered error items of a row: dicts of SQL expressions (NULL message = no error)."""
    req = {c.lower() for c in REQUIRED[regulation]}
    items: list[dict] = []
    code = "code"
    if profile == "row":
        for k, word in [("email", "email"), ("username", "username"), ("personalid", "personal ID"),
                        ("idcardno", "ID card number")]:
            cond = f"{k}_norm IS NOT NULL AND {k}_n > 1 AND row_number <> {k}_first"
            lbl = lit(f"Duplicate {word}")
            msg = (f"CASE WHEN {cond} THEN code || {lit(f' Duplicate {word}: ')} || {k}_norm || "
                   f"' (also in row ' || CAST({k}_first AS VARCHAR) || ')' END")
            items.append(dict(field=lit(k), error_type=lbl, label=lbl, message=msg, value=f"{k}_norm"))
    for col in ACC_COLS:
        if col.lower() not in req:
            continue
        s = s_(col)
        if regulation == "PE" and col == "personalid":
            m = f"CASE WHEN {s} = '' AND upper({strip('citizenship')}) = 'ES' THEN {lit(col + ' is required for Spanish residents')} END"
        else:
            m = f"CASE WHEN {s} = '' THEN {lit(col + ' is required but missing')} END"
        items.append(dict(field=lit(col), error_type=m, label=m, message=f"code || ' ' || {m}", value="''"))
        rt = ALIASES.get(col.lower(), col.lower())
        if rt not in RULES:
            continue
        _, row_head, row_value, label_head, bulk_head, row_text = RULES[rt]
        e = f"(CASE WHEN {s} <> '' THEN {rule_sql(rt, col, regulation)} END)"
        quoted = f"{e} || ': ''' || {s} || ''''"
        if profile == "row":
            if row_text:
                body = f"CASE WHEN {e} IS NOT NULL THEN {lit(row_text)} END"
            else:
                body = _pre(_head(row_head, col), quoted if row_value else e)
            label = _pre(_head(label_head, col), e)
            message = f"{code} || ' ' || {body}"
        else:
            inner = _pre(_head(bulk_head, col), e)
            message = f"{code} || ' ' || {lit(col + ': ')} || {inner} || ': ''' || {s} || ''''"
            label = message
        items.append(dict(field=lit(col), error_type=e, label=label, message=message, value=s))
        if profile == "row" and rt in ("firstname", "lastname"):
            e2 = f"(CASE WHEN {s} <> '' THEN {r_name_len(s, raw_ctx)} END)"
            msg2 = f"{code} || ' ' || {lit(rt + ': ')} || {e2} || ': ''' || {s} || ''''"
            items.append(dict(field=lit(col), error_type=e2, label=e2, message=msg2, value=s))
    cross = [("address/city", x_address_city(raw_ctx)), ("languagecode/countrycode", x_language_country(raw_ctx))]
    if regulation == "PE":
        cross.append(("documents", x_documents_pe(raw_ctx)))
    for name, e in cross:
        message = f"code || ' ' || {e}"
        items.append(dict(field=lit(name), error_type=e, label=e if profile == "row" else message,
                          message=message, value="''"))
    return items


def _dup_cte(src: str = "a") -> str:
    parts = []
    for k, lower in [("email", True), ("username", True), ("personalid", False), ("idcardno", False)]:
        norm = f"lower({strip(k)})" if lower else strip(k)
        parts.append(f"CASE WHEN {k} <> '' THEN {norm} END AS {k}_norm")
    inner = f"SELECT *, {', '.join(parts)} FROM {src}"
    wins = []
    for k in ["email", "username", "personalid", "idcardno"]:
        wins.append(f"min(row_number) OVER (PARTITION BY {k}_norm) AS {k}_first")
        wins.append(f"count(*) OVER (PARTITION BY {k}_norm) AS {k}_n")
    return f"d AS (SELECT *, {', '.join(wins)} FROM ({inner}) AS d0)"


def _errors_cte(regulation: str, profile: str) -> str:
    items = error_items(regulation, profile)
    structs = ", ".join(
        f"CASE WHEN ({it['message']}) IS NOT NULL THEN {{'field': {it['field']}, 'error_type': {it['error_type']}, "
        f"'label': {it['label']}, 'message': {it['message']}, 'value': {it['value']}}} END" for it in items)
    src = "d" if profile == "row" else "a"
    dup = (",\n" + _dup_cte()) if profile == "row" else ""
    return (f"{accounts_cte()}{dup},\n"
            f"r AS (SELECT row_number, code, list_filter([{structs}], lambda x: x IS NOT NULL) AS errs FROM {src})")


def validate_rows_sql(regulation: str, profile: str) -> str:
    return (f"{_errors_cte(regulation, profile)}\n"
            "SELECT row_number, code, len(errs) = 0 AS valid, CAST(len(errs) AS BIGINT) AS n_errors, "
            "array_to_string(list_transform(errs, lambda x: x.message), ' | ') AS errors FROM r")


def error_report_sql(regulation: str, profile: str) -> str:
    return (f"{_errors_cte(regulation, profile)},\n"
            "u AS (SELECT row_number, code, unnest(errs) AS e, generate_subscripts(errs, 1) AS i FROM r)\n"
            "SELECT row_number, code, CAST(i - 1 AS BIGINT) AS pos, e.field AS field_name, e.error_type AS error_type, "
            "e.message AS error_message, e.value AS invalid_value FROM u")


def error_counts_sql(regulation: str, profile: str) -> str:
    return (f"{_errors_cte(regulation, profile)},\n"
            "u AS (SELECT row_number, unnest(errs) AS e, generate_subscripts(errs, 1) AS i FROM r)\n"
            "SELECT e.label AS label, count(*) AS n, arg_min(row_number, row_number * 1000000 + i) AS first_row, "
            "CAST(arg_min(i - 1, row_number * 1000000 + i) AS BIGINT) AS first_pos FROM u GROUP BY e.label")


def summary_sql(regulation: str, profile: str) -> str:
    return (f"{_errors_cte(regulation, profile)}\n"
            "SELECT count(*) AS total_rows, count(*) FILTER (WHERE len(errs) = 0) AS valid_rows, "
            "count(*) FILTER (WHERE len(errs) > 0) AS invalid_rows FROM r")


def single_rule_sql(rule_type: str, col: str, regulation: str | None = None) -> str:
    e = rule_sql(rule_type, col, regulation)
    return (f"{accounts_cte()}\nSELECT row_number, {s_(col)} AS value, error FROM "
            f"(SELECT row_number, {s_(col)}, CASE WHEN {s_(col)} <> '' THEN {e} END AS error FROM a) AS t "
            f"WHERE error IS NOT NULL")


def cross_rule_sql(fn) -> str:
    return f"{accounts_cte()}\nSELECT row_number, error FROM (SELECT row_number, {fn(raw_ctx)} AS error FROM a) AS t WHERE error IS NOT NULL"
