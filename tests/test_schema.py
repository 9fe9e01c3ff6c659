"""Schema operators against brute force (P2, P4, P5, P8) and catalogs."""

from tabvet import fixtures as fx
from tabvet.operators import schema as SC
from tabvet.plans import rulesets as RS

from .conftest import SF_SMALL


def _norm(s):
    import re

    s = re.sub(r"[_\s-]", "", s.lower())
    return re.sub(r"^(customer|user|account|contact)", "", s)


def _suggest(sources, targets):
    """What SURVEY P8 asks of a header, stated per source: an equal target (the last one), or else
    the last free target that contains it or that it contains.  A target is free if it is not the
    equal target of any source, nor the pick of an earlier source."""
    equal = {s: [t for t in targets if _norm(t) == _norm(s)] for s in sources}
    picked = {s: ts[-1] for s, ts in equal.items() if ts}
    for s in (s for s in sources if not equal[s]):
        taken = set(picked.values())
        near = [t for t in targets if t not in taken and (_norm(s) in _norm(t) or _norm(t) in _norm(s))]
        picked.update({s: near[-1]} if near else {})
    return picked


def test_suggest_mappings_matches_brute_force(spark):
    got = {}
    for r in SC.suggest_mappings(fx.headers(spark, SF_SMALL)).collect():
        got.setdefault(r.file, {})[r.source_column] = r.target
    by_file = {}
    for r in fx.headers(spark, SF_SMALL).collect():
        by_file.setdefault(r.file, []).append((r.pos, r.column_name))
    for f, cols in by_file.items():
        want = _suggest([c for _, c in sorted(cols)], SC.EXPECTED_TARGET_FIELDS)
        assert got.get(f, {}) == want, f


def test_rename_ci_collision_keeps_first_position_last_value(spark):
    df = spark.createDataFrame([("a", "b", "c")], "email string, Mail string, x string")
    out = SC.rename_ci(df, {"MAIL": "email"})
    assert out.columns == ["email", "x"] and tuple(out.first()) == ("b", "c")


def test_resolve_required_precedence():
    assert SC.resolve_required("IMS", ["x"]) == RS.IMS_REQUIRED
    assert SC.resolve_required(None, ["x"], ["y"]) == ["x"]
    assert SC.resolve_required(None, None, ["y"]) == ["y"]
    assert SC.resolve_required() == RS.DEFAULT_REQUIRED


def test_catalogs(spark):
    req = RS.required_catalog(spark)
    co = [r.field for r in req.where("regulation = 'CO'").orderBy("pos").collect()]
    assert co.count("birthdate") == 1 and co[0] == "code"
    rules = {(r.regulation, r.rule) for r in RS.rules_catalog(spark).collect()}
    assert ("PE", "zip") in rules and ("PE", "documents") in rules
