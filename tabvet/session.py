"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel

# Pinned "today" for every date rule, so results do not drift with the clock.
DEFAULT_AS_OF = "2025-01-01"


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8,
              app_name: str = "tabvet") -> SparkSession:
    """Session for tests and the benchmark; on a cluster use the session you have."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # HotSpot does not JIT methods above 8000 bytes; past that, whole-stage
        # codegen falls back to per-operator generated code, which it does JIT
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir``, if any."""
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    return spark.conf.get("spark.checkpoint.dir", None) or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the session's checkpoint folder; create a private one only when unset.

    A cluster names a shared folder in ``spark.checkpoint.dir``; a machine-local
    folder is only chosen for a ``local`` master, where nothing is set.
    """
    d = checkpoint_dir(spark)
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="tabvet-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for intermediate tables."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends, and all uses read the same rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, reliable: bool = True) -> DataFrame:
    """Cut lineage of a result that several actions reuse.

    ``reliable=True`` writes a checkpoint to the shared folder (survives lost
    executors); otherwise the frame is persisted memory-and-disk.
    """
    if reliable:
        ensure_checkpoint_dir(df.sparkSession)
        # persisted first, so the checkpoint write does not recompute the plan
        cached = df.persist(StorageLevel.MEMORY_AND_DISK)
        out = cached.checkpoint(eager=True)
        cached.unpersist()
        return out
    return df.persist(StorageLevel.MEMORY_AND_DISK)
