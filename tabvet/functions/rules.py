"""Field rules (V3-V21) and cross-field rules (X1-X3) as Column expressions.

A field rule maps the stripped cell ``s`` (and, for a few rules, the raw cell or
another column) to the first failing message, or NULL when the value passes.
``CASE WHEN`` keeps the order of the checks, so "first message wins" holds.
Everything here compiles to JVM expressions inside whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import full_years, parse_first
from .text import cell, is_blank, pystrip

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's: patterns, messages, lists.
# ``(?U)`` makes \d and \s Unicode-aware in Java, as they are in Python; Python's \s
# also has the four separators U+001C to U+001F.
# ---------------------------------------------------------------------------
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-áéíóúñÁÉÍÓÚÑ$]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
CURRENCY_CODE_PATTERN = r"^[A-Z]{3}$"
PHONE_PATTERN = r"(?U)^\+?\d[\d\s\x1C-\x1F\-\(\)]{8,20}$"
COUNTRY_CODE_PATTERN = r"^[A-Z]{2}$"
LANGUAGE_CODE_PATTERN = r"^[a-z]{2}$"
NAME_PATTERN = r"(?U)^[a-zA-ZáéíóúñÁÉÍÓÚÑ\s\x1C-\x1F\-\'\.]+$"
ZIP_CODE_PATTERN = r"(?U)^[a-zA-Z0-9\s\x1C-\x1F\-]{3,10}$"
REGION_PROVINCE_CODE_PATTERN = r"^[A-Za-z0-9\-_]{1,10}$"
PERSONAL_ID_PATTERN = r"(?U)^[A-Za-z0-9\-\s\x1C-\x1F]+$"
SPANISH_DNI_PATTERN = r"(?U)^\d{8}[A-Z]$"
SPANISH_NIE_PATTERN = r"(?U)^[XYZ]\d{7}[A-Z]$"
PERU_ZIP_LIMA_PATTERN = r"(?U)^LIMA\d{2}$"
PERU_ZIP_5_PATTERN = r"(?U)^\d{5}$"
PERU_ZIP_6_PATTERN = r"(?U)^\d{6}$"

DISPOSABLE_DOMAINS = ["tempmail.org", "10minutemail.com", "guerrillamail.com"]

LANGUAGE_COUNTRIES = {
    "es": ["ES", "MX", "AR", "CO", "PE", "CL", "VE"],
    "en": ["US", "GB", "CA", "AU", "NZ"],
    "fr": ["FR", "CA", "BE", "CH"],
    "de": ["DE", "AT", "CH"],
    "it": ["IT", "CH"],
    "pt": ["PT", "BR"],
}

BIRTHDATE_FORMATS = ["%d/%m/%Y", "%m/%d/%Y"]
SIGNUP_DATE_FORMATS = ["%d/%m/%Y", "%m/%d/%Y", "%Y-%m-%d"]
MIN_AGE = 18
NAME_MAX = 50

MSG_EMAIL_NO_AT = "Email missing @ symbol"
MSG_EMAIL_FORMAT = "Email has invalid format"
MSG_EMAIL_DISPOSABLE = "Disposable email addresses are not allowed"
MSG_BIRTH_FUTURE = "Birthdate is in the future"
MSG_BIRTH_UNDERAGE = "Account holder is underage (age: {})"
MSG_BIRTH_FORMAT = "Invalid birthdate format"
MSG_PHONE = "Phone number has invalid format"
MSG_NAME_LONG = "Name too long (max 50 characters)"
MSG_NAME_CHARS = "Name contains invalid characters"
MSG_REGIONCODE = "Region code contains invalid characters or is too long"
MSG_PROVINCECODE = "Province code contains invalid characters or is too long"
MSG_PROVINCE_SHORT = "Province name too short"
MSG_PROVINCE_LONG = "Province name too long"
MSG_PROVINCE_CHARS = "Province contains invalid characters"
MSG_PID_SHORT = "Personal ID too short"
MSG_PID_LONG = "Personal ID too long"
MSG_PID_CHARS = "Personal ID contains invalid characters"
MSG_PE_CITIZENSHIP_NEEDED = "Citizenship is required for PersonalID validation"
MSG_PE_SPANISH_ID = ("Invalid Spanish ID format. Must be DNI (8 digits + letter) "
                     "or NIE (X/Y/Z + 7 digits + letter)")
MSG_PE_PID_SHORT = "PersonalID is too short (minimum 5 characters)"
MSG_PE_PID_LONG = "PersonalID is too long (maximum 20 characters)"
MSG_PE_PID_CHARS = "PersonalID contains invalid characters"
MSG_IDCARD_SHORT = "ID card number too short"
MSG_IDCARD_LONG = "ID card number too long"
MSG_IDCARD_CHARS = "ID card number contains invalid characters"
MSG_CITIZENSHIP = "Citizenship must be 2 uppercase letters"
MSG_SIGNUP_FUTURE = "Signup date is in the future"
MSG_SIGNUP_FORMAT = "Invalid signup date format"
MSG_CRLF = "Contains line breaks (potential CRLF injection)"
MSG_COUNTRY = "Country code must be 2 uppercase letters"
MSG_ZIP = "Zip code has invalid format"
MSG_PE_ZIP = "Peru zip code must be 5 digits, 6 digits, or LIMA format (LIMAxx)"
MSG_LANGUAGE = "Language code must be 2 lowercase letters"
MSG_CURRENCY = "Not a valid format (should be 3 uppercase letters)"
MSG_REQUIRED = "{} is required but missing"
MSG_REQUIRED_ES = "{} is required for Spanish residents"
MSG_ADDRESS_NO_CITY = "Address provided but city is missing"
MSG_CITY_NO_ADDRESS = "City provided but address is missing"
MSG_LANG_COUNTRY = "Language '{}' not typically used in country '{}'"
MSG_PE_DOCUMENTS = ("Non-residents must provide at least one document: ID card, passport, "
                    "driver's license, or personal ID")
# ---------------------------------------------------------------------------


class RowContext:
    """Case-insensitive access to the raw cells of the row being checked.

    An absent column reads as ``''`` (like ``row.get(name, '')``); when two
    columns differ only by case the later one wins.
    """

    def __init__(self, columns: list[str], as_of: Column):
        self._by_lower = {c.lower(): c for c in columns}
        self.as_of = as_of
        # dates parsed once in an earlier projection: (str(value column), formats) -> column
        self.parsed: dict[tuple[str, tuple[str, ...]], Column] = {}

    def parse_date(self, s: Column, fmts: list[str]) -> Column:
        """``s`` parsed by the first matching format, reusing an earlier parse."""
        return self.parsed.get((str(s), tuple(fmts))) if (str(s), tuple(fmts)) in self.parsed \
            else parse_first(s, fmts)

    def has(self, name: str) -> bool:
        return name.lower() in self._by_lower

    def name(self, name: str) -> str | None:
        return self._by_lower.get(name.lower())

    def raw(self, name: str) -> Column:
        real = self._by_lower.get(name.lower())
        return cell(F.col(f"`{real}`")) if real is not None else F.lit("")

    def stripped(self, name: str) -> Column:
        return pystrip(self.raw(name))


def _first(*cases: tuple[Column, Column | str]) -> Column:
    """``CASE WHEN c1 THEN m1 WHEN c2 THEN m2 ... END`` (NULL when none holds)."""
    expr = None
    for cond, msg in cases:
        m = F.lit(msg) if isinstance(msg, str) else msg
        expr = F.when(cond, m) if expr is None else expr.when(cond, m)
    return expr


def length(c: Column) -> Column:
    return F.length(c)


# --- V3 ---------------------------------------------------------------------
def email_error(s: Column, raw: Column, ctx: RowContext) -> Column:
    return _first(
        (~s.contains("@"), MSG_EMAIL_NO_AT),
        (~s.rlike(EMAIL_PATTERN), MSG_EMAIL_FORMAT),
        (F.split_part(F.lower(s), F.lit("@"), F.lit(2)).isin(DISPOSABLE_DOMAINS), MSG_EMAIL_DISPOSABLE),
    )


# --- V4 ---------------------------------------------------------------------
def birthdate_error(s: Column, raw: Column, ctx: RowContext) -> Column:
    born = ctx.parse_date(s, BIRTHDATE_FORMATS)
    age = full_years(ctx.as_of, born)
    return _first(
        (born.isNull(), MSG_BIRTH_FORMAT),
        (born > ctx.as_of, MSG_BIRTH_FUTURE),
        (age < MIN_AGE, F.format_string(MSG_BIRTH_UNDERAGE.replace("{}", "%d"), age)),
    )


# --- V5 ---------------------------------------------------------------------
def phone_error(s: Column, raw: Column, ctx: RowContext) -> Column:
    return _first((~s.rlike(PHONE_PATTERN), MSG_PHONE))


# --- V6 / V7 ----------------------------------------------------------------
def name_error(s: Column, raw: Column, ctx: RowContext) -> Column:
    return _first((length(s) > NAME_MAX, MSG_NAME_LONG), (~s.rlike(NAME_PATTERN), MSG_NAME_CHARS))


def name_length_error(s: Column, raw: Column, ctx: RowContext) -> Column:
    # the "too short" branch (min 1) cannot fire on a non-blank value
    return _first((length(s) > NAME_MAX, MSG_NAME_LONG))


# --- V8 - V10 ---------------------------------------------------------------
def regioncode_error(s: Column, raw: Column, ctx: RowContext) -> Column:
    return _first((~s.rlike(REGION_PROVINCE_CODE_PATTERN), MSG_REGIONCODE))


def provincecode_error(s: Column, raw: Column, ctx: RowContext) -> Column:
    return _first((~s.rlike(REGION_PROVINCE_CODE_PATTERN), MSG_PROVINCECODE))


def province_error(s: Column, raw: Column, ctx: RowContext) -> Column:
    return _first(
        (length(s) < 2, MSG_PROVINCE_SHORT),
        (length(s) > 50, MSG_PROVINCE_LONG),
        (~s.rlike(NAME_PATTERN), MSG_PROVINCE_CHARS),
    )


# --- V11 - V13 --------------------------------------------------------------
def personalid_error(s: Column, raw: Column, ctx: RowContext) -> Column:
    return _first(
        (length(s) < 5, MSG_PID_SHORT),
        (length(s) > 20, MSG_PID_LONG),
        (~s.rlike(PERSONAL_ID_PATTERN), MSG_PID_CHARS),
    )


def peru_personalid_error(s: Column, raw: Column, ctx: RowContext) -> Column:
    """Conditional rule (U2): depends on the raw ``citizenship`` cell."""
    citizenship = ctx.raw("citizenship")
    spanish = F.upper(pystrip(citizenship)) == F.lit("ES")
    up = F.upper(s)
    return _first(
        (citizenship == F.lit(""), MSG_PE_CITIZENSHIP_NEEDED),
        (spanish & ~(up.rlike(SPANISH_DNI_PATTERN) | up.rlike(SPANISH_NIE_PATTERN)), MSG_PE_SPANISH_ID),
        (spanish, F.lit(None).cast("string")),
        (length(s) < 5, MSG_PE_PID_SHORT),
        (length(s) > 20, MSG_PE_PID_LONG),
        (~s.rlike(PERSONAL_ID_PATTERN), MSG_PE_PID_CHARS),
    )


def idcardno_error(s: Column, raw: Column, ctx: RowContext) -> Column:
    return _first(
        (length(s) < 5, MSG_IDCARD_SHORT),
        (length(s) > 20, MSG_IDCARD_LONG),
        (~s.rlike(PERSONAL_ID_PATTERN), MSG_IDCARD_CHARS),
    )


# --- V14 - V21 --------------------------------------------------------------
def citizenship_error(s: Column, raw: Column, ctx: RowContext) -> Column:
    return _first((~F.upper(s).rlike(COUNTRY_CODE_PATTERN), MSG_CITIZENSHIP))


def signupdate_error(s: Column, raw: Column, ctx: RowContext) -> Column:
    d = ctx.parse_date(s, SIGNUP_DATE_FORMATS)
    return _first((d.isNull(), MSG_SIGNUP_FORMAT), (d > ctx.as_of, MSG_SIGNUP_FUTURE))


def address_error(s: Column, raw: Column, ctx: RowContext) -> Column:
    # line breaks are looked for in the unstripped value
    return _first((raw.rlike("[\\r\\n]"), MSG_CRLF))


def countrycode_error(s: Column, raw: Column, ctx: RowContext) -> Column:
    return _first((~F.upper(s).rlike(COUNTRY_CODE_PATTERN), MSG_COUNTRY))


def zip_error(s: Column, raw: Column, ctx: RowContext) -> Column:
    return _first((~s.rlike(ZIP_CODE_PATTERN), MSG_ZIP))


def peru_zip_error(s: Column, raw: Column, ctx: RowContext) -> Column:
    ok = F.upper(s).rlike(PERU_ZIP_LIMA_PATTERN) | s.rlike(PERU_ZIP_5_PATTERN) | s.rlike(PERU_ZIP_6_PATTERN)
    return _first((~ok, MSG_PE_ZIP))


def language_error(s: Column, raw: Column, ctx: RowContext) -> Column:
    return _first((~F.lower(s).rlike(LANGUAGE_CODE_PATTERN), MSG_LANGUAGE))


def currency_error(s: Column, raw: Column, ctx: RowContext) -> Column:
    return _first((~F.upper(s).rlike(CURRENCY_CODE_PATTERN), MSG_CURRENCY))


# --- V1 / V2 ----------------------------------------------------------------
def required_error(field: str, s: Column) -> Column:
    return _first((s == F.lit(""), MSG_REQUIRED.format(field)))


# --- X1 - X3 ----------------------------------------------------------------
def address_city_error(ctx: RowContext) -> Column:
    address, city = ctx.raw("address"), ctx.raw("city")
    return _first(
        ((address != F.lit("")) & (city == F.lit("")), MSG_ADDRESS_NO_CITY),
        ((city != F.lit("")) & (address == F.lit("")), MSG_CITY_NO_ADDRESS),
    )


def language_country_error(ctx: RowContext) -> Column:
    lang_raw, country_raw = ctx.raw("languagecode"), ctx.raw("countrycode")
    lang = F.lower(pystrip(lang_raw))
    country = F.upper(pystrip(country_raw))
    mismatch = None
    for code, countries in LANGUAGE_COUNTRIES.items():
        branch = (lang == F.lit(code)) & ~country.isin(countries)
        mismatch = branch if mismatch is None else (mismatch | branch)
    both = (lang_raw != F.lit("")) & (country_raw != F.lit(""))
    return _first((both & mismatch, F.format_string(MSG_LANG_COUNTRY.replace("{}", "%s"), lang, country)))


def peru_documents_error(ctx: RowContext) -> Column:
    citizenship = ctx.raw("citizenship")
    foreign = (citizenship != F.lit("")) & (F.upper(pystrip(citizenship)) != F.lit("ES"))
    docs = ["idcardno", "passportid", "DRIVERLICENSENO", "personalid"]
    none_given = None
    for d in docs:
        blank = is_blank(ctx.raw(d))
        none_given = blank if none_given is None else (none_given & blank)
    return _first((foreign & none_given, MSG_PE_DOCUMENTS))


FieldCheck = Callable[[Column, Column, RowContext], Column]
CrossCheck = Callable[[RowContext], Column]


@dataclass(frozen=True)
class Rendering:
    """How a field rule's error is written in each profile.

    ``head`` values: ``None`` (no head), ``"$field"`` (column as written),
    ``"$lower"`` (column in lower case) or a literal word.
    """

    row_head: str | None
    row_value: bool
    label_head: str | None
    bulk_head: str | None
    row_text: str | None = None  # fixed row message replacing the rule message


FIELD = "$field"
LOWER = "$lower"

# rule type -> (default check, rendering).  Field names dispatch by lower case.
FIELD_RULES: dict[str, tuple[FieldCheck, Rendering]] = {
    "email": (email_error, Rendering(None, True, None, None)),
    "birthdate": (birthdate_error, Rendering(None, False, "Birthdate", "Birthdate", row_text="Invalid birthdate")),
    "phone": (phone_error, Rendering(FIELD, True, FIELD, LOWER)),
    "firstname": (name_error, Rendering("firstname", True, None, None)),
    "lastname": (name_error, Rendering("lastname", True, None, None)),
    "regioncode": (regioncode_error, Rendering("regioncode", False, "regioncode", "regioncode")),
    "provincecode": (provincecode_error, Rendering("provincecode", False, "provincecode", "provincecode")),
    "province": (province_error, Rendering("province", False, "province", "province")),
    "personalid": (personalid_error, Rendering("personalid", True, "personalid", "personalid")),
    "idcardno": (idcardno_error, Rendering("idcardno", True, "idcardno", "idcardno")),
    "citizenship": (citizenship_error, Rendering("citizenship", False, "citizenship", "citizenship")),
    "signupdate": (signupdate_error, Rendering("signupdate", False, "signupdate", "signupdate")),
    "address": (address_error, Rendering("address", False, "address", "address")),
    "countrycode": (countrycode_error, Rendering("countrycode", False, "countrycode", "countrycode")),
    "zip": (zip_error, Rendering(FIELD, False, FIELD, LOWER)),
    "signuplanguagecode": (language_error, Rendering("signuplanguagecode", False, "signuplanguagecode",
                                                     "signuplanguagecode")),
    "currencycode": (currency_error, Rendering("currencycode", False, "currencycode", "currencycode")),
}
# column names that share a rule type
FIELD_ALIASES = {"cellphone": "phone", "zipcode": "zip", "postalcode": "zip", "postcode": "zip"}
# rule types that raise a second, length-only error in the row profile (V7)
ROW_SECOND_CHECK = {"firstname": name_length_error, "lastname": name_length_error}


# rule types whose check parses the value as a date, with their formats
DATE_RULES = {"birthdate": BIRTHDATE_FORMATS, "signupdate": SIGNUP_DATE_FORMATS}


def rule_type_of(column: str) -> str | None:
    low = column.lower()
    low = FIELD_ALIASES.get(low, low)
    return low if low in FIELD_RULES else None
