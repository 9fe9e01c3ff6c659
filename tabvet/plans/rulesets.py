"""Named rule sets ("regulations"), their overrides and the rule registry.

Overrides are keyed by rule-set *code* (CO / PE / IMS).  A rule set may
override a field rule type (``personalid``, ``zip``, ...) with another
Column builder, and add a row-level ``documents`` check.  Users register their
own builders with :func:`register_rule` (U3); builders return Columns, so a
custom rule stays inside the same single projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules as R

# Required fields of each rule set, in the reference's order.
CO_REQUIRED = ["code", "firstname", "lastname", "email", "birthdate", "address", "city",
               "countrycode", "zip", "cellphone", "gender", "username", "birthdate",
               "citizenship", "regioncode", "provincecode", "province", "personalid",
               "idcardno", "birthcity", "birthcountrycode"]
PE_REQUIRED = ["code", "firstname", "lastname", "email", "birthdate", "address", "city",
               "countrycode", "zip", "username", "citizenship", "provincecode", "province",
               "personalid", "idcardno", "regioncode"]
IMS_REQUIRED = ["code", "email", "firstname", "lastname"]
DEFAULT_REQUIRED = ["code", "firstname", "lastname", "email", "birthdate", "address", "city",
                    "phone", "cellphone", "countrycode", "signuplanguagecode", "currencycode",
                    "username", "zip", "signupdate", "password"]

# Declared (never enforced by default) constraints, U7.
NAME_DECLARED = r"^[a-zA-ZáéíóúñÁÉÍÓÚÑ\s\-\'\.À-ſ]+$"
CO_DECLARED = {
    "code": {"required": True, "max_length": 20},
    "firstname": {"required": True, "min_length": 2, "max_length": 50, "pattern": NAME_DECLARED},
    "lastname": {"required": True, "min_length": 2, "max_length": 50, "pattern": NAME_DECLARED},
    "birthdate": {"required": True, "min_age": 18},
    "email": {"required": True},
    "countrycode": {"required": True, "pattern": "^[A-Z]{2}$"},
    "gender": {"required": True, "values": ["M", "F"]},
    "citizenship": {"required": True, "pattern": "^[A-Z]{2}$"},
    "regioncode": {"required": True, "pattern": "^[0-9]{1,20}$"},
    "provincecode": {"required": True, "pattern": "^[0-9]{1,20}$"},
    "province": {"required": True, "max_length": 100},
    "personalid": {"required": True, "pattern": "^[A-Z0-9]{5,15}$", "max_length": 10, "min_length": 6},
    "idcardno": {"required": True, "pattern": "^[0-9]{6,12}$", "max_length": 10, "min_length": 6},
    "birthcity": {"required": True, "max_length": 50},
    "birthcountrycode": {"required": True, "pattern": "^[A-Z]{2}$"},
    "cellphone": {"required": True, "pattern": "^[0-9+]{7,15}$"},
    "zip": {"required": True, "pattern": "^[0-9]{5,8}$"},
}
PE_DECLARED = {
    "code": {"required": True, "max_length": 50},
    "firstname": {"required": True, "min_length": 2, "max_length": 50, "pattern": NAME_DECLARED},
    "lastname": {"required": True, "min_length": 2, "max_length": 50, "pattern": NAME_DECLARED},
    "birthdate": {"required": True, "min_age": 18},
    "email": {"required": True},
    "countrycode": {"required": True, "pattern": "^[A-Z]{2}$"},
    "citizenship": {"required": True, "pattern": "^[A-Z]{2}$"},
    "regioncode": {"required": True, "pattern": "^[0-9]{1,20}$"},
    "provincecode": {"required": True, "pattern": "^[0-9]{1,20}$"},
    "province": {"required": True, "max_length": 100},
    "personalid": {"conditional": True, "depends_on": "citizenship", "pattern": "^[A-Z0-9]{5,15}$",
                   "max_length": 10, "min_length": 6},
    "idcardno": {"pattern": "^[0-9]{6,12}$", "max_length": 10, "min_length": 6},
    "passportid": {"pattern": "^[A-Z0-9]{6,15}$", "max_length": 15, "min_length": 6},
    "DRIVERLICENSENO": {"pattern": "^[A-Z0-9]{8,20}$", "max_length": 20, "min_length": 8},
}
IMS_DECLARED = {
    "code": {"required": True, "max_length": 50},
    "firstname": {"required": True, "min_length": 2, "max_length": 50, "pattern": NAME_DECLARED},
    "lastname": {"required": True, "min_length": 2, "max_length": 50, "pattern": NAME_DECLARED},
    "email": {"required": True},
}


@dataclass(frozen=True)
class Conditional:
    """A field that is required where ``condition`` holds for another one.

    ``condition`` is SQL over ``{value}``, the stripped cell of ``depends_on`` (``''`` without that
    column), or a function from that Column to a boolean one; unknown counts as false.
    ``message`` may name the field as ``{}``.
    """

    depends_on: str
    condition: str | Callable
    message: str = R.MSG_REQUIRED

    def holds(self, column: str) -> Column:
        """Over the named column, which has the stripped cells of ``depends_on``."""
        found = self.condition(F.col(column)) if callable(self.condition) else F.expr(self.condition.format(value=f"`{column}`"))
        return F.coalesce(found, F.lit(False))


@dataclass
class RuleSet:
    code: str
    name: str
    required: list[str]
    declared: dict = field(default_factory=dict)
    # field or rule type -> when it is required; it may be blank otherwise
    conditional_required: dict[str, Conditional] = field(default_factory=dict)

    def conditional_for(self, column: str, rule_type: str | None) -> Conditional | None:
        """The condition of a column, by its name (in any case) or its rule type."""
        by_name = {k.lower(): v for k, v in self.conditional_required.items()}
        return by_name.get(column.lower()) or by_name.get((rule_type or "").lower())

    @property
    def required_unique(self) -> list[str]:
        seen, out = set(), []
        for f in self.required:
            if f.lower() not in seen:
                seen.add(f.lower())
                out.append(f)
        return out


RULESETS: dict[str, RuleSet] = {
    "CO": RuleSet("CO", "Columbia", CO_REQUIRED, CO_DECLARED),
    "PE": RuleSet("PE", "Peru", PE_REQUIRED, PE_DECLARED,
                  conditional_required={"personalid": Conditional("citizenship", "upper({value}) = 'ES'", R.MSG_REQUIRED_ES)}),
    "IMS": RuleSet("IMS", "Basic", IMS_REQUIRED, IMS_DECLARED),
}
DEFAULT = RuleSet("DEFAULT", "Default", DEFAULT_REQUIRED, {})


@dataclass(frozen=True)
class RuleEntry:
    kind: str        # "field" (value -> message) or "row" (row -> message)
    builder: Callable
    depends_on: str | None = None


# code -> rule type -> entry.  CO and IMS name their own personalid rule, which
# is the default rule; only PE changes results.
_REGISTRY: dict[str, dict[str, RuleEntry]] = {
    "PE": {
        "personalid": RuleEntry("field", R.peru_personalid_error, depends_on="citizenship"),
        "documents": RuleEntry("row", R.peru_documents_error),
        "zip": RuleEntry("field", R.peru_zip_error),
    },
    "CO": {"personalid": RuleEntry("field", R.personalid_error)},
    "IMS": {"personalid": RuleEntry("field", R.personalid_error)},
}


def get_ruleset(code: str | None, required: list[str] | None = None) -> RuleSet:
    """Rule set by code; else the caller's required list; else the default 16."""
    if code is not None and code in RULESETS:
        return RULESETS[code]
    if required:
        return RuleSet("CUSTOM", "Custom", list(required), {})
    return DEFAULT


def get_rule(code: str | None, rule_type: str) -> RuleEntry | None:
    """The rule set's override, or None to fall back to the default rule."""
    return _REGISTRY.get(code or "", {}).get(rule_type)


def conditional_of(code: str | None, rule_type: str) -> str | None:
    """The column a conditional rule depends on."""
    e = get_rule(code, rule_type)
    return e.depends_on if e is not None else None


def register_rule(code: str, rule_type: str, builder: Callable, kind: str = "field",
                  depends_on: str | None = None) -> None:
    """Add or replace a rule.  ``kind="field"``: ``builder(s, raw, ctx) -> Column``;
    ``kind="row"``: ``builder(ctx) -> Column`` (a cross-field check)."""
    _REGISTRY.setdefault(code, {})[rule_type] = RuleEntry(kind, builder, depends_on)


def unregister_rule(code: str, rule_type: str) -> None:
    _REGISTRY.get(code, {}).pop(rule_type, None)


def row_rules(code: str | None) -> list[tuple[str, RuleEntry]]:
    """Row-level (cross-field) overrides of a rule set, in registration order."""
    return [(k, e) for k, e in _REGISTRY.get(code or "", {}).items() if e.kind == "row"]


def rules_catalog(spark: SparkSession) -> DataFrame:
    """U4: ``(regulation, rule, kind, depends_on)`` for every registered override."""
    rows = [(code, rule, e.kind, e.depends_on)
            for code, entries in sorted(_REGISTRY.items()) for rule, e in entries.items()]
    schema = T.StructType([T.StructField("regulation", T.StringType()),
                           T.StructField("rule", T.StringType()),
                           T.StructField("kind", T.StringType()),
                           T.StructField("depends_on", T.StringType())])
    return spark.createDataFrame(rows, schema)


def required_catalog(spark: SparkSession) -> DataFrame:
    """``required(regulation, name, pos, field)``; CO's repeated birthdate is dropped."""
    rows = []
    for code, rs in list(RULESETS.items()) + [("DEFAULT", DEFAULT)]:
        for pos, f in enumerate(rs.required_unique):
            rows.append((code, rs.name, pos, f))
    schema = T.StructType([T.StructField("regulation", T.StringType()),
                           T.StructField("name", T.StringType()),
                           T.StructField("pos", T.IntegerType()),
                           T.StructField("field", T.StringType())])
    return spark.createDataFrame(rows, schema)


def define_ruleset(code: str, name: str, required: list[str], declared: dict | None = None,
                   conditional: dict[str, Conditional] | None = None) -> RuleSet:
    """Add (or replace) a named rule set; pair it with :func:`register_rule` overrides.

    ``conditional`` names fields of ``required`` that are required under a condition only (U2).
    """
    rs = RuleSet(code, name, list(required), declared or {}, dict(conditional or {}))
    RULESETS[code] = rs
    return rs


def remove_ruleset(code: str) -> None:
    """Forget a rule set and its overrides."""
    RULESETS.pop(code, None)
    _REGISTRY.pop(code, None)
