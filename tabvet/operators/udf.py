"""Validation with a caller-supplied row function.

The escape hatch for checks that cannot be written as Column expressions:
the function receives one row as a dict of strings and returns a list of
error messages.  It runs in ``mapInPandas`` (Arrow batches per partition),
so the work stays partitioned; prefer Column rules for anything expressible.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame

RowFunction = Callable[[dict], list]


def validate_with_function(df: DataFrame, fn: RowFunction, row_number: str = "row_number",
                           sep: str = " | ") -> DataFrame:
    """``row_number, valid, n_errors, errors`` from ``fn`` applied to every row."""
    columns = [c for c in df.columns if c != row_number]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = pdf[columns].fillna("").astype(str).to_dict("records")
            errs = [list(fn(r) or []) for r in rows]
            yield pd.DataFrame({
                "row_number": pdf[row_number].astype("int64"),
                "valid": [len(e) == 0 for e in errs],
                "n_errors": [len(e) for e in errs],
                "errors": [sep.join(e) for e in errs],
            })

    return df.mapInPandas(run, "row_number bigint, valid boolean, n_errors bigint, errors string")
