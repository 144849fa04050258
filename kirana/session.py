"""Spark session helpers.

The session is configured for a cluster first: AQE with skew-join
splitting and partition coalescing, UTC session time, and a checkpoint
directory taken from ``spark.checkpoint.dir`` when the cluster names one.
Only when that setting is absent (tests, local runs) do we create a
scratch directory of our own.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_LOCAL_CHECKPOINT: str | None = None


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "kirana") -> SparkSession:
    """A session; master, shuffle partitions and driver memory are set only when
    given here or in the environment, so that a submitted configuration holds."""
    master = master or os.environ.get("KIRANA_MASTER")
    parts = shuffle_partitions or os.environ.get("KIRANA_SHUFFLE_PARTITIONS")
    memory = os.environ.get("KIRANA_DRIVER_MEMORY", "16g" if (master or "").startswith("local") else "")
    given = {"spark.master": master, "spark.sql.shuffle.partitions": parts, "spark.driver.memory": memory}
    builder = (
        SparkSession.builder.config(map={k: str(v) for k, v in given.items() if v})
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Streaming state of the keyed rules.
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory, creating a local one only
    when the session does not name one (tests / single machine)."""
    global _LOCAL_CHECKPOINT
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
    if _LOCAL_CHECKPOINT is None:
        _LOCAL_CHECKPOINT = tempfile.mkdtemp(prefix="kirana-ckpt-")
    spark.conf.set("spark.checkpoint.dir", _LOCAL_CHECKPOINT)
    spark.sparkContext.setCheckpointDir(_LOCAL_CHECKPOINT)
    return spark.sparkContext.getCheckpointDir() or _LOCAL_CHECKPOINT


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint directory (never a
    machine-local temp folder when the cluster names one)."""
    import uuid
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def written(df, name: str):
    """Write ``df`` under the shared checkpoint directory and read it back: cuts the
    lineage, and plans of later rounds start from the size of the files.  (A
    checkpointed frame keeps the estimate of the plan it came from, which joins
    multiply from round to round.)  Returns the frame and its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete the files of a written frame that is no longer read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
