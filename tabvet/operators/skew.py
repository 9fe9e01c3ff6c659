"""Joins whose hot keys are split over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A table is broadcast up to this size, as it is estimated from its cells.
BROADCAST_BYTES = 64_000_000
#: Bytes of a row in memory beside its cells.
ROW_BYTES = 64


def cell_bytes(*columns: str) -> Column:
    """Estimated bytes of a row with these text columns."""
    return F.lit(ROW_BYTES) + sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``groups``, a written table with one row for each key, whose column ``size``
    is the number of rows that hold the key.

    A key with more rows than an even partition is hot; there are no more such keys than
    partitions.  Its rows get as many salts as the even partitions that they fill (a power of
    two), and its group is copied for each, so no task has many times the rows of the others.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_rows = groups.agg(F.sum(size)).first()[0] or 0
    hashed = F.xxhash64(*[F.col(k) for k in keys])
    hot: dict[int, list[int]] = {}
    for r in groups.where(F.col(size) * n > max(n, n_rows)).select(hashed.alias("h"), F.col(size).alias("s")).collect():
        hot.setdefault(1 << (-(-r["s"] * n // max(1, n_rows)) - 1).bit_length(), []).append(r["h"])
    if not hot:
        return rows.join(groups, keys, how)
    salts = F.lit(1)
    for k, hashes in sorted(hot.items()):
        salts = F.when(hashed.isin(hashes), F.lit(k)).otherwise(salts)
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), salts).cast("int"))
    right = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
