"""Row numbers over whole rows, and what the round's verdict found around them."""

import pytest
from pyspark.sql import functions as F

from tabvet.operators.rownum import number_rows
from tabvet.operators.schema import missing_columns
from tabvet.sources.csv import read_delimited, read_with_fallback

from .conftest import SF_MID


@pytest.mark.parametrize("parts", [8, 64])
def test_numbers_are_dense_on_whole_rows(spark, parts, tmp_path):
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet")
    number_rows(li, ["l_orderkey", "l_linenumber"], num_partitions=parts).write.parquet(str(tmp_path / "n"))
    got = spark.read.parquet(str(tmp_path / "n")).agg(F.count("*").alias("n"), F.max("row_number").alias("m"), F.count_distinct("row_number").alias("d")).first()
    assert got["n"] == got["m"] == got["d"] == li.count()


def test_mappings_chain(spark):
    headers = spark.createDataFrame([("f", 0, "a")], "file string, pos int, column_name string")
    assert missing_columns(headers, ["c"], {"a": "b", "b": "c"}).count() == 0


def test_headers_that_differ_are_refused(spark, tmp_path):
    (tmp_path / "1.csv").write_text("email,code\nx@y.z,1\n")
    (tmp_path / "2.csv").write_text("code,email\n2,q@y.z\n")
    with pytest.raises(Exception):
        read_delimited(spark, str(tmp_path)).collect()


def test_path_with_a_space(spark, tmp_path):
    d = tmp_path / "a b"
    d.mkdir()
    (d / "1.csv").write_text("email,code\nx@y.z,1\n")
    assert [tuple(r) for r in read_with_fallback(spark, str(d)).collect()] == [("x@y.z", "1")]
