"""Differential test: every registered query against its DuckDB oracle."""

import pytest

import __spark_entry__ as E
from tabvet.catalog import ORACLE, QUERIES
from scripts.compare import compare

from .conftest import SF_SMALL



def test_every_query_is_documented():
    assert set(ORACLE) <= set(QUERIES)
    # rows-only checks are the exceptions, not the rule
    assert len(set(QUERIES) - set(ORACLE)) <= 4


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, name):
    r = compare(spark, SF_SMALL, name, QUERIES[name], ORACLE.get(name))
    assert r["ok"] is not False, r
    assert r["ok"] or r["rows"] > 0, r


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["row_number", "code", "valid", "n_errors", "errors"]
