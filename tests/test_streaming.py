"""Stream = batch for ST1 and ST2, over several micro-batches."""

import glob
import os

from pyspark.sql import functions as F

from tabvet import fixtures as fx
from tabvet.operators.validate import render, validate
from tabvet.session import scratch_path
from tabvet.streaming import stream as ST

from .conftest import SF_SMALL


def test_first_seen_over_many_batches_equals_batch(spark):
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    src = scratch_path(spark, "events-split")
    # four parts written one after another (so they arrive in event order),
    # read one file per micro-batch
    part = (F.col("event_id") * 4 / events.count()).cast("int")
    for p in range(4):
        events.where(part == p).coalesce(1).write.parquet(f"{src}/p{p}")
    stream = (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
                   .option("recursiveFileLookup", "true").parquet(src))
    out = ST.first_seen_stream(stream.select(*events.columns), "user_id", "event_id", "t-first-seen")
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("event_id", "user_id", "first_id").collect())
    firsts = events.groupBy("user_id").agg(F.min("event_id").alias("first_id"))
    want = sorted(tuple(r) for r in events.join(firsts, "user_id")
                  .where(F.col("event_id") != F.col("first_id"))
                  .select("event_id", "user_id", "first_id").collect())
    assert got == want and len(want) > 0


def test_stream_validate_equals_batch(spark):
    acc = fx.accounts(spark, SF_SMALL)
    src = scratch_path(spark, "accounts-src")
    acc.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(acc.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = ST.run_to_table(ST.validate_stream(stream, "CO"), "t-validate")
    got = sorted(tuple(r) for r in render(spark.read.parquet(out)).collect())
    want = sorted(tuple(r) for r in render(validate(acc, "CO", "bulk")).collect())
    assert got == want


def _parts(df, key, src, n):
    """``n`` folders that can be made visible one after another."""
    part = (F.col(key) * n / (df.agg(F.max(key)).first()[0] + 1)).cast("int")
    for p in range(n):
        df.where(part == p).coalesce(1).write.parquet(f"{src}-held/p{p}")
    return [f"{src}-held/p{p}" for p in range(n)]


def _state_bytes(folder):
    files = [f for f in glob.glob(f"{folder.removeprefix('file:')}/checkpoint/state/**", recursive=True) if f.endswith(".delta")]
    return {f: os.path.getsize(f) for f in files}


def test_first_seen_goes_on_after_a_restart(spark):
    """Three runs of one query, each with more input: together they are the batch result."""
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    src, folder = scratch_path(spark, "events-restart"), scratch_path(spark, "first-seen-restart")
    for part in _parts(events, "event_id", src, 3):
        spark.read.parquet(part).write.mode("append").parquet(src)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
        out = ST.first_seen_stream(stream, "user_id", "event_id", folder=folder)
    firsts = events.groupBy("user_id").agg(F.min("event_id").alias("first_id"))
    want = sorted(tuple(r) for r in events.join(firsts, "user_id").where(F.col("event_id") != F.col("first_id")).select("event_id", "user_id", "first_id").collect())
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("event_id", "user_id", "first_id").collect()) == want


def test_state_written_by_a_batch_is_that_of_its_keys(spark):
    """A batch with one new key adds a small state change, however many keys the state holds."""
    schema, src, folder = "id long, k string", scratch_path(spark, "keys"), scratch_path(spark, "state")
    run = lambda: ST.first_seen_stream(spark.readStream.schema(schema).parquet(src), "k", "id", folder=folder)
    spark.range(3000).selectExpr("id", "concat('key', id) AS k").write.parquet(src)
    run()
    before = _state_bytes(folder)
    spark.createDataFrame([(5000, "key7"), (5001, "new"), (5002, "new"), (5003, None)], schema).write.mode("append").parquet(src)
    out = run()
    after = _state_bytes(folder)
    assert sum(v for f, v in after.items() if f not in before) < sum(before.values()) / 5
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("id", "k", "first_id").collect()) == [(5000, "key7", 7), (5002, "new", 5001)]


def test_stream_validate_goes_on_after_a_restart(spark):
    acc = fx.accounts(spark, SF_SMALL)
    src, folder = scratch_path(spark, "accounts-restart"), scratch_path(spark, "validate-restart")
    for part in _parts(acc, "row_number", src, 3):
        spark.read.parquet(part).write.mode("append").parquet(src)
        out = ST.run_to_table(ST.validate_stream(spark.readStream.schema(acc.schema).parquet(src), "PE"), "t", folder=folder)
    got = sorted(tuple(r) for r in render(spark.read.parquet(out)).collect())
    assert got == sorted(tuple(r) for r in render(validate(acc, "PE", "bulk")).collect())
