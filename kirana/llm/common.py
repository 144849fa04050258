"""Small helpers shared by the operators: written stages, Arrow columns, texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kirana.session import checkpoint_dir, scratch_path

#: Deleting these characters gives the normalised text; runs without them are words.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows in one Arrow batch that Spark hands to a Python worker.  Texts may be
#: long, so batches are kept well below Spark's default of 10,000 rows.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Name the checkpoint folder and keep the Arrow batches of texts small."""
    checkpoint_dir(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage with files that all executors share, so a lost executor
    costs the tasks it ran and not the stages before them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_stage(df: DataFrame) -> None:
    """Delete the files of a staged frame that no later step reads."""
    spark, path = df.sparkSession, getattr(df, "_staged_at", None)
    if path:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def squeezed(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (length + 1) of an Arrow string column; null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def texts(column: pa.Array) -> list[str]:
    """Python strings of an Arrow string column; null is empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
