"""Structured Streaming (ST1, ST2).

ST1 runs the same rule projection over an unbounded source: the rules are
stateless, so the streaming plan is the batch plan.

ST2 keeps the first row seen for every key across micro-batches (the
reference's chunk loop) in Spark's keyed state store: a batch reads and writes the state of
its own keys only, and the store, the offsets and the output are committed together, so a
restarted query goes on where it stopped.  As in the reference, the state grows with
the number of distinct keys and has no watermark; for many keys, name the RocksDB provider in
``spark.sql.streaming.stateStore.providerClass``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.validate import check_rows
from ..plans import rulesets as RS
from ..session import scratch_path


def validate_stream(stream: DataFrame, ruleset=None, as_of: str = "2025-01-01",
                    row_number: str = "row_number") -> DataFrame:
    """ST1: the bulk-profile rule projection on a streaming DataFrame (stateless)."""
    if not isinstance(ruleset, RS.RuleSet):
        ruleset = RS.get_ruleset(ruleset)
    return check_rows(stream, ruleset, "bulk", as_of, row_number)


def run_to_table(stream: DataFrame, name: str, fmt: str = "parquet", folder: str | None = None) -> str:
    """Drain a stream with ``availableNow`` into a folder; returns the output folder.

    A later call with the same ``folder`` goes on where the earlier one ended; without
    one a new folder under the checkpoint dir is used.
    """
    folder = folder or scratch_path(stream.sparkSession, name)
    out, ckpt = f"{folder}/out", f"{folder}/checkpoint"
    q = (stream.writeStream.format(fmt).option("path", out).option("checkpointLocation", ckpt)
               .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def _first_seen(id_col: str, key: str):
    def update(keys: tuple, frames: Iterator, state) -> Iterator:
        import numpy as np
        import pandas as pd

        # of a key's rows in this batch only the ids are held
        ids = np.concatenate([f[id_col].to_numpy() for f in frames])
        first = state.get[0] if state.exists else int(ids.min())
        if not state.exists:
            state.update((first,))
        later = np.sort(ids[ids != first])
        for s in range(0, len(later), 10_000):
            part = later[s : s + 10_000]
            yield pd.DataFrame({id_col: part, key: [keys[0]] * len(part), "first_id": np.full(len(part), first)})

    return update


def first_seen_stream(stream: DataFrame, key: str, id_col: str, name: str = "first-seen",
                      folder: str | None = None) -> str:
    """ST2: write ``id, key, first_id`` for every row whose key was seen before.

    "Before" is an earlier micro-batch, or a lower ``id_col`` (a long) in the same one.  Rows without a
    key or an id are left out.  Returns the output folder.  State, output and checkpoint live in
    ``folder``; a later call with the same folder goes on where the earlier one ended.
    Without one a new folder under the checkpoint dir is used.
    """
    rows = stream.select(F.col(id_col).cast("long").alias(id_col), key).where(F.col(id_col).isNotNull() & F.col(key).isNotNull())
    schema = f"`{id_col}` long, `{key}` {dict(stream.dtypes)[key]}, first_id long"
    flagged = rows.groupBy(key).applyInPandasWithState(_first_seen(id_col, key), schema, "first_id long", "append", "NoTimeout")
    return run_to_table(flagged, name, folder=folder)
