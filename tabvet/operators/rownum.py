"""Dense, global, 1-based row numbers without a single-partition window.

Range-partition on the order key, sort inside each partition, and write the rows
with their partition and place to the shared scratch folder.  One small aggregate
of that table counts the rows of every partition, a running sum gives each
partition's offset, and a row's number is its offset plus its place.  Counting and
numbering read the same written rows: two range shuffles would sample their bounds
apart and not agree.  The offsets have one row per partition, so broadcasting them
is bounded by the partition count, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def number_rows(df: DataFrame, order_by: list[str], column: str = "row_number",
                num_partitions: int | None = None) -> DataFrame:
    """Number rows 1..N in ``order_by`` order (ties broken by the input; use a unique key)."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by)
                .withColumn("__pid", F.spark_partition_id())
                .withColumn("__mid", F.monotonically_increasing_id()))
    path = scratch_path(spark, "numbered")
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    counts = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__base"))
    offsets = counts.select(
        "__pid", "__base",
        (F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1))).alias("__off"))
    return (ranged.join(F.broadcast(offsets), "__pid")
                  .select(*[F.col(f"`{c}`") for c in df.columns],
                          (F.coalesce(F.col("__off"), F.lit(0)) + F.col("__mid") - F.col("__base") + 1)
                          .cast("bigint").alias(column)))
