"""SRC2: the stream of call events from files of JSON lines.

Every line is an event ``{"event": ..., "call_sid": ..., "ts": ..., ...}``.  Spark's file
source keeps the offsets, so a query that is stopped and started again with its checkpoint
reads each file once; a line that is no such object stays as a row whose ``bad_line`` holds
it, so that nothing is lost or stops the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event STRING, call_sid STRING, call BIGINT, event_id BIGINT, ts TIMESTAMP, value DOUBLE, duration DOUBLE, order_id STRING, _bad STRING"


def event_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Streaming events: call_sid, call, event_id, ts, kind, value, duration, order_id and ``bad_line``."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", max_files_per_trigger).load(path)
    e = lines.select("value", F.from_json("value", EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("e"))
    known = F.col("e._bad").isNull() & F.col("e.event").isNotNull()
    fields = ["call_sid", "call", "event_id", "ts", F.col("event").alias("kind"), "value", "duration", "order_id"]
    return (e.select(F.when(known, F.col("e")).alias("e"), F.when(~known, F.col("value")).alias("bad_line"))
            .select("e.*", "bad_line").select(*fields, "bad_line"))


def write_events(events: DataFrame, path: str) -> None:
    """Events (the columns above) as JSON lines, in more files of the folder."""
    events.withColumnRenamed("kind", "event").write.mode("append").option("ignoreNullFields", "true").json(path)
