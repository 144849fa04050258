"""Registered streaming queries: each replays a time-split copy of its input
with ``availableNow`` and returns the sink read back, so the batch twin's SQL
checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from kirana.plans.base import REGISTRY, query
from kirana.plans.q_calls import BARGE, ECHO, GAP, SEG_SQL, US, WARMUP
from kirana.plans.q_ledger import MOVE_ORDER
from kirana.sources import tables as tb
from kirana.streaming import ops as so
from kirana.streaming.keyed import run_keyed
from kirana.streaming.replay import read_replay, replay_files, run_to_table, run_updates, slice_parts

#: Rows of the replays below arrive up to a day after their time, in files that overlap.
ARRIVAL, LATENESS = 86400, "2 days"


def _stream(spark, df, ts, n_files=4, flush=True, late_seconds=0):
    parts = slice_parts(df, n_files)
    root, schema = replay_files(df, ts, n_files, flush=flush, late_seconds=late_seconds, parts=parts)
    return read_replay(spark, root, schema, parts)


def _late(spark, df, ts="ts"):
    return _stream(spark, df, ts, 3, late_seconds=ARRIVAL)


@query("stream_daily_kpis")
def q_stream_daily_kpis(spark, d):
    o = tb.load(spark, d).orders
    return run_to_table(so.stream_daily_kpis(_stream(spark, o, "created_at")), "daily-kpis")


@query("stream_dedup_calls")
def q_stream_dedup_calls(spark, d):
    e = tb.load(spark, d).call_events
    return run_updates(so.stream_dedup_calls(_stream(spark, e, "ts", flush=False)), "dedup-calls", ["call_sid"])


@query("stream_speech_sessions", f"""
    SELECT call, count(*) AS n_loud, min(ts) AS start_ts, max(ts) AS last_loud_ts FROM (
      SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > {GAP * US} THEN 1 ELSE 0 END)
                  OVER (PARTITION BY call ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sess
      FROM (SELECT *, lag(ts) OVER (PARTITION BY call ORDER BY ts, event_id) AS prev FROM v_frames WHERE loud))
    GROUP BY call, sess""")
def q_stream_speech_sessions(spark, d):
    f = tb.load(spark, d).frames
    out = run_to_table(so.stream_speech_sessions(_stream(spark, f, "ts"), f"{GAP} seconds"), "sessions")
    return out.select("call", "n_loud", "start_ts", "last_loud_ts")


@query("stream_frame_windows")
def q_stream_frame_windows(spark, d):
    f = tb.load(spark, d).frames
    return run_to_table(so.stream_frame_windows(_stream(spark, f, "ts"), "1 hour"), "frame-windows")


@query("stream_call_state")
def q_stream_call_state(spark, d):
    rows = run_keyed(so.stream_call_state(_late(spark, tb.load(spark, d).call_events), LATENESS), "call-state")[0]
    return so.latest_rows(rows, "call_sid").select("call_sid", "call", "call_status", "duration_seconds", "order_id", "summary", "started_at", "ended_at", "n_starts", "n_ends")


@query("stream_frame_windows_sliding")
def q_stream_frame_windows_sliding(spark, d):
    f = tb.load(spark, d).frames
    return run_to_table(so.stream_frame_windows(_stream(spark, f, "ts"), "6 hours", "1 hour"), "frame-windows-sliding")


@query("stream_speech_segments", f"SELECT * EXCLUDE (closed) FROM ({SEG_SQL}) WHERE closed")
def q_stream_speech_segments(spark, d):
    out = run_keyed(so.stream_speech_segments(_late(spark, tb.load(spark, d).frames), GAP, lateness=LATENESS), "segments")[0]
    return out.select("call", "seg", "start_ts", "last_loud_ts", "end_ts", "n_loud", "n_frames")


@query("stream_batches")
def q_stream_batches(spark, d):
    return run_keyed(so.stream_batches(_late(spark, tb.load(spark, d).frames), 5, LATENESS), "batches")[0].withColumnRenamed("batch_no", "batch")


@query("stream_echo_gate")
def q_stream_echo_gate(spark, d):
    return run_keyed(so.stream_echo_gate(_late(spark, tb.load(spark, d).call_events), ECHO, lateness=LATENESS), "echo-gate")[0]


@query("stream_barge_in")
def q_stream_barge_in(spark, d):
    # the bound calls go on for the year of the table
    return run_to_table(so.stream_barge_in(_late(spark, tb.load(spark, d).call_events), BARGE, 800 * 86400, LATENESS), "barge-in")


@query("stream_order_lock")
def q_stream_order_lock(spark, d):
    return run_keyed(so.stream_order_lock(_late(spark, tb.load(spark, d).call_events), LATENESS), "order-lock")[0]


@query("stream_warmup")
def q_stream_warmup(spark, d):
    return run_keyed(so.stream_warmup(_late(spark, tb.load(spark, d).frames), WARMUP, LATENESS), "warmup")[0]


@query("stream_stock_ledger")
def q_stream_stock_ledger(spark, d):
    t = tb.load(spark, d)
    opening = t.products.select(F.col("id").alias("product_id"), F.col("stock_quantity").alias("opening"))
    moves = t.stock_moves.join(opening, "product_id", "left")
    out = run_keyed(so.stream_stock_ledger(_late(spark, moves), MOVE_ORDER, LATENESS), "stock-ledger")[0]
    return out.select("product_id", "ts", "l_orderkey", "l_linenumber", "l_suppkey", "delta", "balance")


@query("stream_dedup_starts", "SELECT call, event_id FROM v_call_events WHERE kind = 'start'")
def q_stream_dedup_starts(spark, d):
    """Each start is logged by the webhook and seconds later by the bridge; which of the two stays is left open."""
    e = tb.load(spark, d).call_events.select("call", "event_id", "ts", "kind")
    again = e.withColumn("ts", F.col("ts") + F.expr("INTERVAL 3 SECOND"))
    return run_to_table(so.stream_dedup_starts(_stream(spark, e.unionByName(again), "ts"), ["call", "event_id"]), "dedup-starts").select("call", "event_id")


# the batch twins' oracles check the streamed results
for _k, _twin in (("stream_daily_kpis", "daily_kpis"), ("stream_call_state", "latest_call_state"),
                  ("stream_dedup_calls", "dedup_calls"), ("stream_frame_windows", "frame_windows"),
                  ("stream_frame_windows_sliding", "frame_windows_sliding"), ("stream_batches", "frame_batches"),
                  ("stream_echo_gate", "echo_gate"), ("stream_barge_in", "barge_in"), ("stream_order_lock", "order_lock"),
                  ("stream_warmup", "warmup_discard"), ("stream_stock_ledger", "stock_ledger")):
    REGISTRY[_k].sql = REGISTRY[_twin].sql
