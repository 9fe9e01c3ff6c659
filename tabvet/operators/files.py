"""From files to a report: scan, rename, validate (M1) and the preview of a scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import DEFAULT_AS_OF, written
from ..sources.csv import CSV_GLOB
from ..sources.records import FileScan, scan_files
from .report import ValidationReport, validation_report
from .schema import rename_ci, rename_exact


class OverlongRecord(ValueError):
    """A record has more cells than its file's header (an error in the bulk profile)."""


@dataclass
class FileReport:
    """What a run over files answers: the scan (rows, refused records, file profiles) and the report."""

    scan: FileScan
    report: ValidationReport


def preview_files(scan: FileScan, n: int = 10) -> DataFrame:
    """The first ``n`` records in file order, each with its file's dialect and number of
    columns, and the total of records."""
    number, file = scan.rows.columns[:2]
    total = scan.files.agg(F.sum("records")).first()[0] or 0
    first = scan.rows.orderBy(number).limit(n)
    about = scan.files.select(F.col("file").alias(file), "encoding", "delimiter", "enclosure", F.col("columns").alias("n_columns"))
    return first.join(about, file).withColumn("total_rows", F.lit(total).cast("long"))


def validate_files(
    spark: SparkSession, path, ruleset=None, profile: str = "row", mappings: dict[str, str] | None = None, as_of: str = DEFAULT_AS_OF,
    glob: str | None = CSV_GLOB, delimiter: str | None = None, quote: str | None = '"',
) -> FileReport:
    """Validate all CSV files under ``path`` as one table, in file order.

    The row profile renames columns in any letter case and leaves out the cells that a record has too many;
    the bulk profile renames exact names and raises :class:`OverlongRecord`.
    Records are written once, so files are not parsed again for each check.
    """
    scan = scan_files(spark, path, glob, delimiter, quote)
    if profile == "bulk":
        first = scan.refused.orderBy("row_number").limit(1).collect()
        if first:
            raise OverlongRecord(f"{first[0]['file']}: record {first[0]['row_number']} has {first[0]['cells']} cells, expected {first[0]['columns']}")
    number, file = scan.rows.columns[:2]
    rows = written(scan.rows.drop(file), "scanned")
    rename = rename_ci if profile == "row" else rename_exact
    rows = rename(rows, {k: v for k, v in (mappings or {}).items() if k != number})
    return FileReport(scan, validation_report(rows, ruleset, profile, as_of, number))
