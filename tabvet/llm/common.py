"""What the operators share: input rows, stored intermediate tables, salted joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rownum import number_rows
from ..session import scratch_path

#: Stands for a null id inside an operator; restored to null in its result.
NULL_ID = -(2**63)


#: Tables of ids are broadcast up to this size, by their counted rows.
BROADCAST_BYTES = 64_000_000
_ID_ROW_BYTES = 64
#: A table of a few numbers a row has no more files than its counted rows ask for.
ROWS_PER_FILE = 100_000


def few(ids: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, broadcast if its counted rows are few."""
    return F.broadcast(ids) if ids.count() * _ID_ROW_BYTES <= BROADCAST_BYTES else ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Partitions of an explicit shuffle; sized by the session, as for any Spark shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id`` (null becomes NULL_ID) and ``_text`` (null becomes empty), row for row."""
    return docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"),
    )


def _unique(ids: DataFrame) -> bool:
    n = ids.agg(F.count("*").alias("n"), F.count_distinct("_id").alias("d")).first()
    return n["n"] == n["d"]


def one_row_per_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """``id_and_text`` with one row for each id and text, and the ids by inner key.

    Rows that are equal in id (null is an id) and text are one document; rows that
    share an id alone are not.  Where ids are unique, which is tested on the id column
    alone, they are the keys: the texts are not shuffled and there is no second table.
    Otherwise ``_id`` is a row number in the order of ids, written once, and the second
    table has the id (``_outer``) of each.
    """
    rows = id_and_text(docs, id_col, text_col)
    if _unique(rows.select("_id")):
        return rows, None
    rows = rows.groupBy("_id", "_text").agg(F.xxhash64("_text").alias("_h")).withColumnRenamed("_id", "_outer")
    rows = number_rows(rows, ["_outer", "_h"], "_id")
    return rows.select("_id", "_text"), rows.select("_id", "_outer")


def with_ids(rows: DataFrame, ids: DataFrame | None, key: str = "_id", name: str = "doc_id") -> DataFrame:
    """``rows`` with ``name``, the id of the inner key ``key`` as the caller knows it."""
    if ids is None:
        return rows.withColumn(name, outer_id(key))
    ids = ids.select(F.col("_id").alias("_named"), outer_id("_outer").alias(name))
    return rows.join(ids, F.col(key) == F.col("_named")).drop("_named")


def one_document_per_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole rows, one for each id and text as in ``one_row_per_text``, with the inner key ``_row``."""
    ids = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID))
    if _unique(docs.select(ids.alias("_id"))):
        return docs.withColumn("_row", ids)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    order = [F.xxhash64(F.to_json(F.struct(F.col(f"`{c}`")))) for c in docs.columns]
    best = F.max_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(*order))
    rows = docs.groupBy(ids.alias("_key"), text.alias("_text")).agg(best.alias("_best")).select("_best.*", "_key", F.xxhash64("_text").alias("_h"))
    return number_rows(rows, ["_key", "_h"], "_row").drop("_key", "_h")


def outer_id(name: str = "_id") -> Column:
    """The id as the caller knows it."""
    return F.when(F.col(name) != F.lit(NULL_ID), F.col(name))


def stored(df: DataFrame, name: str, codec: str = "snappy", rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage ends here.

    ``rows``, a counted bound of the rows of a table of a few numbers a row, keeps a small
    table from being written by as many tasks as a shuffle has partitions.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(rows // ROWS_PER_FILE + 1)
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sliced(batches, limit: int = 1_000_000, column: int = -1):
    """Record batches cut to about ``limit`` bytes of a column of texts.

    Spark's batches have 10,000 rows whatever their bytes, and a worker keeps for later tasks
    what its largest batch took; so an operator's own arrays are of one slice at a time.
    """
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        at, size = 0, 0
        for k, s in enumerate(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False).astype(np.int64).tolist()):
            size += s
            if size >= limit or k == len(b) - 1:
                yield b.slice(at, k + 1 - at)
                at, size = k + 1, 0


def salted_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, n_rows: int) -> DataFrame:
    """Inner join of ``rows`` to one-row-per-key ``groups``, hot keys split by salt.

    ``groups[size]`` is the number of rows that hold the key and ``n_rows`` their total.  A key is
    hot if it has more rows than an even partition; there are no more such keys than partitions, so
    their hashes are a bounded list that goes into the plan.  A hot key gets as many salts as the even
    partitions that its rows fill, rounded up to a power of two: its groups are copied that often, in
    all no more than four times the number of partitions.
    """
    n = partitions(rows.sparkSession)
    hashed = F.xxhash64(*[F.col(k) for k in keys])
    hot: dict[int, list[int]] = {}
    for r in groups.where(F.col(size) * n > max(n, n_rows)).groupBy(hashed.alias("h")).agg(F.max(size).alias("s")).collect():
        hot.setdefault(1 << (-(-r["s"] * n // max(1, n_rows)) - 1).bit_length(), []).append(r["h"])
    if not hot:
        return rows.join(groups, keys)
    salts = F.lit(1)
    for k, hashes in sorted(hot.items()):
        salts = F.when(hashed.isin(hashes), F.lit(k)).otherwise(salts)
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), salts).cast("int"))
    right = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, n_rows: int) -> DataFrame:
    """``salted_join`` to a written table of a few numbers a row: where its counted rows are few
    it is broadcast, so that ``rows`` stay where they are, hot keys too."""
    if groups.count() * _ID_ROW_BYTES <= BROADCAST_BYTES:
        return rows.join(F.broadcast(groups), keys)
    return salted_join(rows, groups, keys, size, n_rows)
