"""Error-report sinks.

Both write in parallel, one file per partition, into a folder; the CSV sink
sorts by (row_number, position) first so the part files read in row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: headings of the exported error report, in order.
CSV_HEADINGS = ["Row Number", "Code", "Field Name", "Error Type", "Invalid Value", "Full Error Message"]
_CSV_SOURCE = ["row_number", "code", "field_name", "error_type", "invalid_value", "error_message"]


def write_errors_json(errors: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The error records as JSON lines."""
    errors.write.mode(mode).json(path)


def write_errors_csv(errors: DataFrame, path: str, mode: str = "overwrite", order: list[str] | None = None) -> None:
    """The error report as CSV with the reference's headings, in row order."""
    order = order or ["row_number", "seq" if "seq" in errors.columns else "pos"]
    out = errors.orderBy(*order).select(*[F.col(s).alias(h) for s, h in zip(_CSV_SOURCE, CSV_HEADINGS)])
    (out.write.mode(mode).option("header", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
