"""Rule truth tables on literal values."""

import pytest
from pyspark.sql import functions as F

from tabvet.functions import rules as R
from tabvet.functions.text import cell, pystrip


def run(spark, rule, values, extra=None):
    cols = ["v"] + sorted((extra or {}).keys())
    rows = [(v, *[(extra or {})[k][i] for k in cols[1:]]) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    ctx = R.RowContext(df.columns, F.lit("2025-01-01").cast("date"))
    raw = cell(F.col("v"))
    s = pystrip(raw)
    return [r[0] for r in df.select(F.when(s != "", rule(s, raw, ctx))).collect()]


def test_email(spark):
    got = run(spark, R.email_error, ["a@b.com", "no-at", "a b@c.com", "x@TempMail.org", " u@x.io ",
                                     "a,b@x.com", "a!b@x.com", "a@b@c.com"])
    assert got == [None, R.MSG_EMAIL_NO_AT, R.MSG_EMAIL_FORMAT, R.MSG_EMAIL_DISPOSABLE, None,
                   None, R.MSG_EMAIL_FORMAT, None]


def test_birthdate(spark):
    got = run(spark, R.birthdate_error, ["01/02/1990", "12/31/1980", "29/02/2001", "01/02/2090",
                                         "15/06/2015", "2015-01-01", "1/2/2000", "001/02/2000",
                                         "01/01/0000", "29/02/2000", "02/01/2007", "01/01/2007"])
    assert got == [None, None, R.MSG_BIRTH_FORMAT, R.MSG_BIRTH_FUTURE,
                   "Account holder is underage (age: 9)", R.MSG_BIRTH_FORMAT, None, R.MSG_BIRTH_FORMAT,
                   R.MSG_BIRTH_FORMAT, None, "Account holder is underage (age: 17)", None]


def test_signupdate(spark):
    got = run(spark, R.signupdate_error, ["2024-01-05", "2024.01.01", "2090-01-01", "31/12/2024", "2024-1-5"])
    assert got == [None, R.MSG_SIGNUP_FORMAT, R.MSG_SIGNUP_FUTURE, None, None]


def test_phone_and_unicode_digits(spark):
    arabic = "١٢٣٤٥٦٧٨٩"
    got = run(spark, R.phone_error, ["+51 999 000001", "123", "(01) 555-0001", arabic])
    assert got == [None, R.MSG_PHONE, R.MSG_PHONE, None]   # a leading "(" is not a digit


def test_names(spark):
    got = run(spark, R.name_error, ["Ana", "J0hn", "a" * 51, "O'Brien-Díaz", "Smith_7", "José"])
    assert got == [None, R.MSG_NAME_CHARS, R.MSG_NAME_LONG, None, R.MSG_NAME_CHARS, None]


def test_codes(spark):
    assert run(spark, R.citizenship_error, ["es", "ESP", " pe "]) == [None, R.MSG_CITIZENSHIP, None]
    assert run(spark, R.countrycode_error, ["US", "PER"]) == [None, R.MSG_COUNTRY]
    assert run(spark, R.language_error, ["ES", "eng"]) == [None, R.MSG_LANGUAGE]
    assert run(spark, R.currency_error, ["pen", "US"]) == [None, R.MSG_CURRENCY]
    assert run(spark, R.regioncode_error, ["R_1", "R 1", "A" * 11]) == [None, R.MSG_REGIONCODE, R.MSG_REGIONCODE]
    assert run(spark, R.province_error, ["X", "Lima", "Lima 1"]) == [R.MSG_PROVINCE_SHORT, None, R.MSG_PROVINCE_CHARS]


def test_ids(spark):
    assert run(spark, R.personalid_error, ["12", "9" * 21, "ID_000004", "ABC-123"]) == \
        [R.MSG_PID_SHORT, R.MSG_PID_LONG, R.MSG_PID_CHARS, None]
    assert run(spark, R.idcardno_error, ["12 4", "#12345", "00000002"]) == \
        [R.MSG_IDCARD_SHORT, R.MSG_IDCARD_CHARS, None]


def test_peru_personalid(spark):
    got = run(spark, R.peru_personalid_error, ["12345678z", "X1234567A", "12", "ID_000004", "12345", "abc12"],
              {"citizenship": ["ES", " es", "ES", "PE", "", "  "]})
    assert got == [None, None, R.MSG_PE_SPANISH_ID, R.MSG_PE_PID_CHARS, R.MSG_PE_CITIZENSHIP_NEEDED, None]


def test_zip(spark):
    assert run(spark, R.zip_error, ["AB-12", "1!", "12"]) == [None, R.MSG_ZIP, R.MSG_ZIP]
    assert run(spark, R.peru_zip_error, ["lima01", "15001", "150001", "AB-12"]) == [None, None, None, R.MSG_PE_ZIP]


def test_crlf_uses_raw_value(spark):
    assert run(spark, R.address_error, ["1 Main\nSt", "a\r", "plain"]) == [R.MSG_CRLF, R.MSG_CRLF, None]


def test_strip_is_python_strip(spark):
    from tabvet.functions.text import PY_WHITESPACE

    expected = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    assert PY_WHITESPACE == expected
    df = spark.createDataFrame([("   x 　\x1c",)], "v string")
    assert df.select(pystrip(F.col("v"))).first()[0] == "x"


def test_cross_rules(spark):
    df = spark.createDataFrame(
        [("a", "", "es", "US", "PE", "", "", "", ""), ("", "Lima", "EN", "us", "ES", "", "", "", ""),
         ("a", "b", "zz", "PE", " ", "", "", "", ""), ("", "", "", "", "PE", "1", "", "", "")],
        "address string, city string, languagecode string, countrycode string, citizenship string, "
        "idcardno string, passportid string, DRIVERLICENSENO string, personalid string")
    ctx = R.RowContext(df.columns, F.lit("2025-01-01").cast("date"))
    got = df.select(R.address_city_error(ctx), R.language_country_error(ctx), R.peru_documents_error(ctx)).collect()
    assert [tuple(r) for r in got] == [
        (R.MSG_ADDRESS_NO_CITY, "Language 'es' not typically used in country 'US'", R.MSG_PE_DOCUMENTS),
        (R.MSG_CITY_NO_ADDRESS, None, None),
        (None, None, R.MSG_PE_DOCUMENTS),
        (None, None, None),
    ]


def test_strip_non_ascii_ends(spark):
    vals = [" x", "　y ", "\tz", "\x85w\x85", "ok", "", "   "]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    assert [r[0] for r in df.select(pystrip(F.col("v"))).collect()] == [v.strip() for v in vals]
