"""Rules that depend on what a key did before, on Spark's own keyed state.

Rows of a key are held until the watermark has passed them and are then handed to the
rule in order of event time, so files may arrive in any order within the lateness; rows
later than that are dropped by the watermark and counted (``run_keyed``).  A key's state
is a rule's few values and the rows held; it lives in the state store, with checkpoints
and recovery by Spark, and is cleared by a timer when the key has been idle for ``idle``
seconds of event time.

A rule is ``(state, row) -> (state, rows)`` over plain tuples; ``state`` is None at first.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from kirana.session import scratch_path

Rule = Callable[[tuple | None, dict], tuple[tuple | None, list[tuple]]]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of keys; a task holds the rows of one at a time.
GROUPS = 1024
#: Rows handed to Spark at once, and the state of a new key.
_OUT_ROWS, _NEW = 10_000, (None, None)


class InOrder(StatefulProcessor):
    """Holds the rows of a group of keys until the watermark passes them, then applies a rule in each key's order.

    Rows come and are held as Arrow columns; ``_nulls`` has a bit for each null among ``names``."""

    def __init__(self, rule: Rule, key: str, names: Sequence[str], ties: Sequence[str], shape: pa.Schema, out: Sequence[str], idle_ms: int):
        self.rule, self.key, self.names, self.ties, self.shape, self.out, self.idle_ms = rule, key, list(names), list(ties), shape, list(out), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "rows binary, first bigint")
        self.states = handle.getValueState("states", "states binary")

    def _table(self) -> pa.Table | None:
        return pa.ipc.open_stream(self.held.get()[0]).read_all() if self.held.exists() else None

    def _hold(self, rows: pa.Table) -> None:
        if not rows.num_rows:
            self.held.clear()
            return
        sink, first = pa.BufferOutputStream(), pc.min(rows["_us"]).as_py()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
            writer.write_table(rows)
        self.held.update((sink.getvalue().to_pybytes(), first))
        self.handle.registerTimer(-(-first // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self._table()
        # by place, as Spark renames columns that begin with an underscore; time and group come first
        new = [pa.table([pa.array(r.iloc[:, n + 2].to_numpy(), f.type, from_pandas=False) for n, f in enumerate(self.shape)], schema=self.shape) for r in rows]
        self._hold(pa.concat_tables(new if old is None else [old, *new]).combine_chunks())
        return iter(())

    def _sorted(self, due: pa.Table) -> pa.Table:
        """By key, time and ``ties``: nulls first, not-a-number last."""
        by = {"_key": due[self.key], "_us": due["_us"]}
        for c in self.ties:
            if pa.types.is_floating(due[c].type):
                by[f"_nan_{c}"] = pc.is_nan(due[c])
            by[c] = due[c]
        at = pc.sort_indices(pa.table(by), sort_keys=[(c, "ascending") for c in by], null_placement="at_start")
        return due.take(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_ms = timerValues.getCurrentWatermarkInMs()
        states = pickle.loads(self.states.get()[0]) if self.states.exists() else {}
        held, made = self._table(), []
        if held is not None and self.held.get()[1] <= now_ms * 1000:
            late = pc.greater(held["_us"], now_ms * 1000)
            self._hold(held.filter(late).combine_chunks())
            due = held.filter(pc.invert(late))
            for n, c in enumerate(self.names):  # nulls again
                null = pc.not_equal(pc.bit_wise_and(due["_nulls"], 1 << n), 0)
                due = due.set_column(due.schema.get_field_index(c), c, pc.if_else(null, pa.scalar(None, due[c].type), due[c]))
            due = self._sorted(due).drop_columns("_nulls")
            names, at = due.column_names, due.column_names.index(self.key)
            for values in zip(*[c.to_pylist() for c in due.columns]):
                row = dict(zip(names, values))
                state, rows = self.rule(states.get(values[at], _NEW)[0], row)
                states[values[at]] = state, row["_us"]
                made += [(values[at], *r) for r in rows]
        # keys idle for so long, with no rows held, start anew
        waiting = set(held.filter(pc.greater(held["_us"], now_ms * 1000))[self.key].unique().to_pylist()) if held is not None else set()
        states = {k: s for k, s in states.items() if s[1] // 1000 + self.idle_ms > now_ms or k in waiting}
        if states:
            self.states.update((pickle.dumps(states, 5),))
            if not waiting:
                self.handle.registerTimer(min(us for _, us in states.values()) // 1000 + self.idle_ms)
        else:
            self.states.clear()
        for k in range(0, len(made), _OUT_ROWS):
            # pandas would make null of not-a-number: its places go along
            nan = [sum(1 << n for n, v in enumerate(row) if v != v) for row in made[k:k + _OUT_ROWS]]
            yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(self.out, [*zip(*made[k:k + _OUT_ROWS]), nan])})

    def close(self) -> None:
        pass


def _unknown(kind: T.DataType) -> Column:
    """A value that stands for null, which ``_nulls`` tells apart."""
    if isinstance(kind, T.StringType):
        return F.lit("")
    return F.lit(False) if isinstance(kind, T.BooleanType) else F.lit(0).cast(kind) if isinstance(kind, T.NumericType) else F.lit("1970-01-01").cast(kind)


def in_order(events: DataFrame, key: str, ts: str, order: Sequence[str], use: Sequence[str], rule: Rule, out: str,
             lateness: str = "1 day", idle: float = 3650 * 86400.0, only: Column | None = None, groups: int = GROUPS) -> DataFrame:
    """A streaming frame of ``key`` and the columns of ``out`` that ``rule`` makes from the rows of ``events``.

    ``order`` breaks ties of one time, ``use`` are further columns that the rule reads;
    rows outside ``only`` are not held.  ``groups`` holds for the life of a checkpoint."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kept = [*order, *[c for c in use if c not in order]]
    live = events.withWatermark(ts, lateness)
    if "_flush" in events.columns:  # see replay: the predicate names the event time, so it stays above the watermark
        live = live.filter(~F.col("_flush") | F.col(ts).isNull())
    if only is not None:
        live = live.filter(only | F.col(ts).isNull())
    names = [key, *kept]
    kinds = {c: live.schema[c].dataType for c in names}
    bits = [F.when(F.col(c).isNull(), F.lit(1 << n)).otherwise(F.lit(0)).cast("bigint") for n, c in enumerate(names)]
    live = live.filter(F.col(ts).isNotNull()).select(
        ts, F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("_group"), *[F.coalesce(F.col(c), _unknown(kinds[c])).alias(c) for c in names],
        F.unix_micros(ts).alias("_us"), reduce(Column.__add__, bits).alias("_nulls"))
    schema = T.StructType([T.StructField(key, kinds[key]), *T._parse_datatype_string(out).fields])
    shape = to_arrow_schema(T.StructType([live.schema[c] for c in [*names, "_us", "_nulls"]]))
    processor = InOrder(rule, key, names, order, shape, [*schema.names, "nan_"], int(idle * 1000))
    made = live.groupBy("_group").transformWithStateInPandas(processor, schema.add("nan_", T.LongType()), "append", "eventTime")
    real = {f.name: n for n, f in enumerate(schema) if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return made.withColumns({c: F.when(F.col("nan_").bitwiseAND(1 << n) != 0, F.lit(float("nan")).cast(schema[c].dataType)).otherwise(F.col(c)) for c, n in real.items()}).drop("nan_")


def run_keyed(stream_df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Run such a stream over what is there, and the number of rows that came too late."""
    spark = stream_df.sparkSession
    out = scratch_path(spark, f"keyed-{name}")
    q = (stream_df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", out + "-ckpt").option("path", out)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    late = sum(op.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for op in p["stateOperators"])
    return spark.read.schema(stream_df.schema).parquet(out), late
