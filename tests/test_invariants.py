"""Invariants and known answers and plan guards (§5.7)."""

from pyspark.sql import functions as F

from tabvet import fixtures as fx
from tabvet.operators import duplicates as D
from tabvet.operators import report as RP
from tabvet.operators.validate import render, validate

from .conftest import SF_MID, SF_SMALL


def test_summary_adds_up_and_counts_match(spark, accounts):
    for profile in ("row", "bulk"):
        res = validate(accounts, "PE", profile)
        s = RP.validity_summary(res).first()
        assert s.total_rows == s.valid_rows + s.invalid_rows == accounts.count()
        n_report = RP.error_report(res).count()
        assert n_report == RP.error_counts(res).agg(F.sum("n")).first()[0]


def test_known_duplicate_counts(spark):
    acc = fx.accounts(spark, SF_MID)
    bulk = {r.field: r.n_values for r in D.duplicate_counts(acc, profile="bulk").collect()}
    assert bulk == {"email": 20, "username": 1, "personalid": 43, "idcardno": 3}
    row = {r.field: r.n_values for r in D.duplicate_counts(acc, profile="row").collect()}
    assert row["personalid"] == 84 and row["idcardno"] == 4


def test_first_seen_flags_bulk_normalisation_count(spark):
    acc = fx.accounts(spark, SF_MID)
    idx = D.duplicate_index(acc, None, "bulk")
    groups = idx.groupBy("field", "value").count()
    flagged = groups.agg(F.sum(F.col("count") - 1)).first()[0]
    assert flagged == 1202


def test_unchanged_under_repartitioning(spark, accounts):
    a = sorted(tuple(r) for r in render(validate(accounts, "CO", "row")).collect())
    b = sorted(tuple(r) for r in render(validate(accounts.repartition(7), "CO", "row")).collect())
    assert a == b


def test_rule_projection_has_no_python_and_stays_in_codegen(spark, accounts):
    df = render(validate(accounts, "PE", "bulk"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "*(" in plan        # whole-stage codegen spans


def test_scan_prunes_columns(spark):
    acc = fx.accounts(spark, SF_MID)
    plan = validate(acc, "IMS", "bulk")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int>" in plan


def _executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_duplicate_index_single_aggregation(spark, accounts):
    plan = _executed(D.duplicate_groups(D.duplicate_keys(accounts, None, "bulk")))
    # one aggregation on (field, value) serves all four keys
    assert plan.count("HashAggregate(keys=[field") == 2      # partial + final


def test_report_validates_once(spark, accounts):
    rep = RP.validation_report(accounts, "PE", "row")
    res = validate(accounts, "PE", "row")
    assert rep.summary.first() == RP.validity_summary(res).first() and rep.summary.first().total_rows == accounts.count()
    assert sorted(tuple(r) for r in rep.errors.collect()) == sorted(tuple(r) for r in RP.error_report(res).collect())
    assert [tuple(r)[:3] for r in rep.error_counts.collect()] == [tuple(r)[:3] for r in RP.error_counts_sorted(res).collect()]
    assert sorted(tuple(r) for r in render(rep.results).collect()) == sorted(tuple(r) for r in render(res).collect())
    assert rep.has_errors() and rep.totals["errors"] == rep.errors.count()
    # everything reads what was written: no rule runs again, and no error array is shuffled
    for df in (rep.summary, rep.error_counts, rep.errors, rep.results):
        plan = _executed(df)
        assert "c_custkey" not in plan
    assert "hashpartitioning(row_number" not in _executed(rep.errors) and "Exchange hashpartitioning(row_number" not in _executed(rep.results)


def test_duplicate_errors_are_merged_without_a_shuffle_of_the_rows(spark, accounts):
    plan = _executed(validate(accounts, "PE", "row"))
    assert "hashpartitioning(row_number" not in plan and "BroadcastHashJoin" in plan


def test_many_flagged_rows_are_joined_by_a_shuffle(spark, accounts, monkeypatch):
    from tabvet.operators import validate as V

    want = sorted(tuple(r) for r in render(validate(accounts, "PE", "row")).collect())
    monkeypatch.setattr(V, "BROADCAST_BYTES", 0)
    assert sorted(tuple(r) for r in render(validate(accounts, "PE", "row")).collect()) == want


def test_value_in_half_of_all_rows_is_split(spark):
    """The rows of a hot value fill no partition of the join far beyond the others."""
    rows = spark.range(20_000).selectExpr("id + 1 AS row_number", "concat('c', id) AS code", "CASE WHEN id % 2 = 0 THEN 'hot@x.y' ELSE concat('u', id div 4, '@x.y') END AS email")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(old, ("false", "-1", "32")):
            spark.conf.set(k, v)
        flagged = D.first_seen_errors(rows)
        sizes = [r["n"] for r in flagged.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        sizes_of_index = [r["n"] for r in D.duplicate_index(rows, ["email"]).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        hot = flagged.where(F.col("error.value") == "hot@x.y").count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert hot == 9999 and max(sizes) < 3000 and max(sizes_of_index) < 3000


def test_counts_keep_their_order_for_large_row_numbers(spark):
    base = 2**43
    rows = spark.createDataFrame([(base + k, "c", "bad", "J0hn", "Sm1th") for k in (5, 3, 9)], "row_number long, code string, email string, firstname string, lastname string")
    counts = RP.error_counts(validate(rows, "IMS", "bulk"))
    plan = _executed(counts)
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    got = RP.error_counts_sorted(validate(rows, "IMS", "row")).collect()
    # a label that one row has twice is first met at its first place
    assert [(r["label"], r["n"], r["first_row"] - base, r["first_pos"]) for r in got] == [("Name contains invalid characters", 6, 3, 1), ("Email missing @ symbol", 3, 3, 0), ("Duplicate email", 2, 5, 0)] or got[0]["first_row"] == base + 3


def test_error_report_does_not_copy_the_rule_set_into_a_filter(spark, accounts):
    """A size filter inferred from the explode held every rule: 0.6 MB of plan, and no end once the report was filtered."""
    from tabvet.catalog import QUERIES

    report = RP.error_report(validate(accounts, "PE", "bulk"))
    assert len(report._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    errors = [r for r in report.collect() if r["error_type"] == "personalid is required for Spanish residents"]
    got = QUERIES["rule_conditional_required"](spark, SF_SMALL).collect()
    assert len(got) > 0 and sorted(r["row_number"] for r in got) == sorted(r["row_number"] for r in errors)


def test_required_errors_are_those_of_the_whole_report(spark, accounts):
    """The filter on field and type is planned within the driver's memory, and loses no error."""
    from tabvet.catalog import QUERIES

    query = QUERIES["rule_required"](spark, SF_SMALL)
    assert len(query._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    errors = [(r["row_number"], r["field_name"]) for r in RP.error_report(validate(accounts, "DEFAULT", "bulk")).collect() if r["error_type"] == r["field_name"] + " is required but missing"]
    assert len(errors) > 0 and sorted(tuple(r)[:2] for r in query.collect()) == sorted(errors)


def test_separators_are_white_space_as_in_python(spark):
    from tabvet.functions import rules as R

    df = spark.createDataFrame([("Ana\x1cMaria", "12\x1d345", "+51\x1e999 123456")], "name string, zip string, phone string")
    assert all(df.select(F.col(c).rlike(p)).first()[0] for c, p in (("name", R.NAME_PATTERN), ("zip", R.ZIP_CODE_PATTERN), ("phone", R.PHONE_PATTERN)))
