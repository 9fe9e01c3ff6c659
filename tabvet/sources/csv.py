"""Delimited-text scans.

Cells are read as strings only (no schema inference, ``NA`` stays ``NA``) and
NULL from the reader becomes ``''``.  Here the dialect is given and headers are the
same; ``multi_line=True``, the default, reads line breaks in quoted cells but makes
each file one split.  :func:`tabvet.sources.records.scan_files` finds dialects and
headers, numbers the records and splits files whatever their cells hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CSV_GLOB = "*.[cC][sS][vV]"   # S10: only *.csv, extension in any case


def _reader(spark: SparkSession, sep: str, quote: str, encoding: str, multi_line: bool,
            glob: str | None, header: bool = True):
    r = (spark.read.option("header", header).option("inferSchema", False)
         .option("sep", sep).option("quote", quote if quote else "\u0000").option("escape", '"')
         .option("multiLine", multi_line).option("encoding", encoding)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .option("mode", "PERMISSIVE"))
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r


def as_strings(df: DataFrame) -> DataFrame:
    """Every column as a string, NULL read as ``''`` (pandas ``na_filter=False``)."""
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def read_delimited(spark: SparkSession, path, sep: str = ",", quote: str = '"',
                   encoding: str = "UTF-8", multi_line: bool = True, glob: str | None = CSV_GLOB,
                   columns: list[str] | None = None, header: bool = True) -> DataFrame:
    """Header row, all strings, blank lines skipped, ``''`` for missing.

    With ``columns`` given, the file is read with that schema (header row
    still skipped) and rows with too few or too many cells are kept: missing
    cells read as ``''``, extra cells are dropped (S2).
    """
    r = _reader(spark, sep, quote, encoding, multi_line, glob, header)
    if columns is None and header:
        r = r.option("enforceSchema", False)   # files whose headers differ are refused, not mixed
    if columns is not None:
        r = r.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return as_strings(r.csv(path))


def read_with_fallback(spark: SparkSession, path, sep: str = ",", quote: str = '"', glob: str | None = CSV_GLOB) -> DataFrame:
    """S3: each file read as UTF-8 when all its bytes are valid UTF-8, else as Latin-1.

    The reference's chain (detected, utf-8, latin1, cp1252, utf-8 with
    replacement) always stops at latin1 for non-UTF-8 bytes, since latin1
    decodes anything.  Encodings are found by the counting pass of
    :func:`tabvet.sources.records.scan_files`; no list of files goes through the driver.
    """
    from .records import scan_files

    rows = scan_files(spark, path, glob, sep, quote).rows
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns[2:]])


def preview(df: DataFrame, n: int = 10, order_by: str = "row_number") -> DataFrame:
    """The first ``n`` records in row order (a top-n, not a full sort)."""
    return df.orderBy(order_by).limit(n)


def row_count(df: DataFrame) -> DataFrame:
    """Exact record count (embedded newlines do not inflate it)."""
    return df.agg(F.count(F.lit(1)).alias("rows"))
