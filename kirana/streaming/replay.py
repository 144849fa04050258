"""Replays of a table as a file stream, and runs of streams into tables.

Production jobs point ``readStream`` at the real landing folder; a replay writes
a table there as ``n_files`` time slices of ``parts`` files in one job (a range
partitioning by time; rows without a time come first) and dates the files in that
order, which is the order in which the file source takes them, a slice at a time.
With ``flush``, two later slices follow, whose files have one sentinel row each far in
the future (``_flush = true``): the first advances the watermark, the second starts the
batch that evicts the windows still open (``availableNow`` runs no batch without data).  Windowed
operators drop the sentinel right after ``withWatermark``.  Everything lives
under the shared checkpoint folder.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kirana.session import scratch_path


#: Rows of a replay's file: what one task reads and aggregates of a micro-batch.
PART_ROWS = 100_000


def _date_in_order(spark: SparkSession, root: str) -> None:
    """Modification times a second apart, in the order of the partitions."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in files.listStatus(path(root)))
    first = int(time.time() - 10 * 86400) * 1000
    for k, name in enumerate(n for n in names if n.startswith("part-")):
        files.setTimes(path(f"{root}/{name}"), first + 1000 * k, -1)


def slice_parts(df: DataFrame, n_files: int) -> int:
    """Files a slice, so that a task reads about ``PART_ROWS`` rows of it however large the table is."""
    return max(1, -(-df.count() // (n_files * PART_ROWS)))


def replay_files(df: DataFrame, ts_col: str, n_files: int = 4, flush_days: int = 3650, flush: bool = True,
                 late_seconds: int = 0, parts: int = 1) -> tuple[str, object]:
    """With ``late_seconds`` a row arrives up to so much after its time, so files overlap in time."""
    spark = df.sparkSession
    root = scratch_path(spark, "replay")
    data = df.withColumn("_flush", F.lit(False)) if flush else df
    arrives = F.unix_micros(ts_col)
    if late_seconds:
        arrives = arrives + F.pmod(F.xxhash64(*df.columns), F.lit(late_seconds)) * 1_000_000
    data.repartitionByRange(n_files * parts, arrives).write.parquet(root)
    _date_in_order(spark, root)
    last = df.agg(F.max(ts_col)).first()[0] if flush else None
    if last is not None:
        values = {f.name: F.lit(None).cast(f.dataType) for f in data.schema.fields} | {"_flush": F.lit(True)}
        for days in (flush_days, flush_days + 1):
            row = values | {ts_col: (F.lit(last) + F.make_dt_interval(F.lit(days))).cast(data.schema[ts_col].dataType)}
            spark.range(0, parts, 1, parts).select(*[v.alias(k) for k, v in row.items()]).write.mode("append").parquet(root)
    return root, data.schema


def read_replay(spark: SparkSession, root: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(root)


def run_to_table(stream_df: DataFrame, name: str, output_mode: str = "append") -> DataFrame:
    """Run a streaming query with ``availableNow`` into a parquet sink under the
    checkpoint folder and return the sink read back as a batch DataFrame."""
    spark = stream_df.sparkSession
    out = scratch_path(spark, f"sink-{name}")
    q = (stream_df.writeStream.format("parquet").outputMode(output_mode)
         .option("checkpointLocation", out + "-ckpt").option("path", out)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream_df.schema).parquet(out)


def run_updates(stream_df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run a streaming query in ``update`` mode with ``availableNow``; each micro-batch's
    changed rows are written under its number (again, if it is retried), and the
    latest row per ``keys`` is returned as a batch DataFrame."""
    spark = stream_df.sparkSession
    out = scratch_path(spark, f"updates-{name}")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = (stream_df.writeStream.outputMode("update").foreachBatch(put)
         .option("checkpointLocation", out + "-ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    rest = [c for c in stream_df.columns if c not in keys]
    rows = spark.read.parquet(out)
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("_last"))
            .select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest]))
