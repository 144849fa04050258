"""Registered queries: call events, frames, turns and audio chunks.

Times are scaled to the test data (events are hours apart per user, see
FIXTURES.md §2): turn gap 6 h, warm-up 1 day, echo hold 8 h, barge-in 8 h.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kirana.operators import calls as cl
from kirana.plans.base import query
from kirana.sources import tables as tb
from kirana.sources.tables import phone_format

GAP, WARMUP, ECHO, BARGE = 6 * 3600, 86400, 8 * 3600, 8 * 3600
US = 1_000_000

WIN = "PARTITION BY call ORDER BY ts, event_id"
PREV = f"OVER ({WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
UPTO = f"OVER ({WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

SEG_SQL = f"""
WITH a AS (SELECT call, ts, event_id, loud,
                  last_value(CASE WHEN loud THEN ts END IGNORE NULLS) {PREV} AS prev_loud FROM v_frames),
b AS (SELECT *, (NOT loud AND prev_loud IS NOT NULL AND epoch_us(ts) - epoch_us(prev_loud) >= {GAP * US})
                AS closes FROM a),
c AS (SELECT *, last_value(CASE WHEN closes THEN ts END IGNORE NULLS) {PREV} AS last_close FROM b),
d AS (SELECT *, loud AND (prev_loud IS NULL OR (last_close IS NOT NULL AND last_close > prev_loud)) AS new_seg
      FROM c),
e AS (SELECT *, sum(CASE WHEN new_seg THEN 1 ELSE 0 END) {UPTO} AS seg FROM d)
SELECT call, seg, min(CASE WHEN loud THEN ts END) AS start_ts, max(CASE WHEN loud THEN ts END) AS last_loud_ts,
       min(CASE WHEN closes THEN ts END) AS end_ts, sum(CASE WHEN loud THEN 1 ELSE 0 END)::BIGINT AS n_loud,
       count(*) AS n_frames, min(CASE WHEN closes THEN ts END) IS NOT NULL AS closed
FROM e WHERE loud OR (prev_loud IS NOT NULL AND (last_close IS NULL OR last_close < prev_loud))
GROUP BY call, seg"""


@query("speech_segments", SEG_SQL)
def q_speech_segments(spark, d):
    f = tb.load(spark, d).frames
    return cl.speech_segments(f, GAP).select("call", F.col("seg").cast("bigint").alias("seg"), "start_ts",
                                             "last_loud_ts", "end_ts", "n_loud", "n_frames", "closed")


@query("frame_batches", """
    SELECT call, batch, count(*) AS n_frames, min(ts) AS first_ts, max(ts) AS last_ts,
           round(avg(energy), 6) AS mean_energy
    FROM (SELECT *, (row_number() OVER (PARTITION BY call ORDER BY ts, event_id) - 1) // 5 AS batch FROM v_frames)
    GROUP BY call, batch HAVING count(*) = 5""")
def q_frame_batches(spark, d):
    return cl.frame_batches(tb.load(spark, d).frames, 5)


@query("warmup_discard", f"""
    SELECT f.call, f.event_id, f.ts FROM v_frames f
    JOIN (SELECT call, min(ts) AS s FROM v_frames GROUP BY call) s ON s.call = f.call
    WHERE epoch_us(f.ts) - epoch_us(s.s) >= {WARMUP * US}""")
def q_warmup_discard(spark, d):
    return cl.warmup_discard(tb.load(spark, d).frames, WARMUP).select("call", "event_id", "ts")


STATE_SQL = """
SELECT call_sid, call,
       CASE WHEN arg_max(kind, (ts, event_id)) = 'end' THEN 'COMPLETED' ELSE 'IN_PROGRESS' END AS call_status,
       coalesce(greatest(0, CAST(trunc(arg_max(duration, (ts, event_id)) FILTER (WHERE kind = 'end')) AS BIGINT)), 0)
         AS duration_seconds,
       arg_max(order_id, (ts, event_id)) FILTER (WHERE order_id IS NOT NULL) AS order_id,
       CASE WHEN count(*) FILTER (WHERE kind = 'end') = 0 THEN NULL
            WHEN arg_max_null(order_id, (ts, event_id)) FILTER (WHERE kind = 'end') IS NOT NULL
            THEN 'Order ' || arg_max_null(order_id, (ts, event_id)) FILTER (WHERE kind = 'end') || ' placed'
            ELSE 'Call completed' END AS summary,
       min(ts) FILTER (WHERE kind = 'start') AS started_at, max(ts) FILTER (WHERE kind = 'end') AS ended_at,
       count(*) FILTER (WHERE kind = 'start') AS n_starts, count(*) FILTER (WHERE kind = 'end') AS n_ends
FROM v_call_events WHERE kind IN ('start', 'end') GROUP BY call_sid, call"""
CALL_CTES = {"v_call_state": STATE_SQL}


def _state(spark, d):
    return cl.latest_call_state(tb.load(spark, d).call_events)


@query("latest_call_state", "SELECT * FROM v_call_state", ctes=CALL_CTES)
def q_latest_call_state(spark, d):
    return _state(spark, d)


@query("call_outcomes", """
    SELECT call_status, count(*) AS n_calls, sum(duration_seconds)::BIGINT AS total_seconds,
           round(avg(duration_seconds), 4) AS avg_seconds,
           round(avg(CASE WHEN order_id IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS share_with_order
    FROM v_call_state GROUP BY call_status""", ctes=CALL_CTES)
def q_call_outcomes(spark, d):
    return cl.call_outcomes(_state(spark, d))


@query("recent_calls", """
    SELECT call_sid, call_status, started_at FROM v_call_state ORDER BY started_at DESC, call_sid DESC LIMIT 50""",
       ctes=CALL_CTES)
def q_recent_calls(spark, d):
    return cl.recent_calls(_state(spark, d), 50).select("call_sid", "call_status", "started_at")


@query("call_orders", """
    SELECT s.call_sid, s.order_id, o.status AS order_status, o.total_amount, o.order_id IS NOT NULL AS order_found
    FROM v_call_state s LEFT JOIN v_orders o ON o.order_id = s.order_id""", ctes=CALL_CTES)
def q_call_orders(spark, d):
    t = tb.load(spark, d)
    return cl.call_orders(_state(spark, d).select("call_sid", "order_id"), t.orders).select(
        "call_sid", "order_id", "order_status", "total_amount", "order_found")


def _call_phone_sql(col: str) -> str:
    b = f"CAST(9000000000 + {col} AS VARCHAR)"
    return (f"CASE {col} % 4 WHEN 0 THEN '+91' || {b} WHEN 1 THEN {b} WHEN 2 THEN '0' || {b} "
            f"ELSE '+91 ' || substr({b}, 1, 5) || '-' || substr({b}, 6, 5) END")


@query("call_orders_asof", """
    SELECT c.call_sid, c.started_at, o.order_id, o.created_at AS order_created_at
    FROM v_call_state c
    LEFT JOIN LATERAL (
      SELECT order_id, created_at FROM v_orders o
      WHERE substr(regexp_replace(o.customer_phone, '[^0-9]', '', 'g'), -10) = CAST(9000000000 + c.call AS VARCHAR)
        AND o.created_at <= c.started_at
      ORDER BY created_at DESC, order_id DESC LIMIT 1) o ON true
    WHERE c.started_at IS NOT NULL""", ctes=CALL_CTES)
def q_call_orders_asof(spark, d):
    t = tb.load(spark, d)
    calls = (_state(spark, d).filter(F.col("started_at").isNotNull())
             .withColumn("caller_phone", phone_format(F.col("call") % 4, F.col("call"))))
    return cl.asof_orders(calls, t.orders)


@query("order_next_call", """
    SELECT o.order_id, o.created_at, c.call_sid, c.started_at
    FROM v_orders o
    LEFT JOIN (SELECT CAST(9000000000 + call AS VARCHAR) AS phone, call_sid, started_at FROM v_call_state
               WHERE started_at IS NOT NULL) c
      ON c.phone = substr(regexp_replace(o.customer_phone, '[^0-9]', '', 'g'), -10) AND c.started_at >= o.created_at
    QUALIFY row_number() OVER (PARTITION BY o.order_id ORDER BY c.started_at, c.call_sid) = 1""", ctes=CALL_CTES)
def q_order_next_call(spark, d):
    """The forward form of J6 with the sides exchanged: calls come after all orders in the tables."""
    o = tb.load(spark, d).orders.select(F.col("order_id").alias("call_sid"), F.col("created_at").alias("started_at"),
                                        F.col("customer_phone").alias("caller_phone"))
    calls = _state(spark, d).filter(F.col("started_at").isNotNull()).select(
        F.col("call_sid").alias("order_id"), F.col("started_at").alias("created_at"),
        phone_format(F.col("call") % 4, F.col("call")).alias("customer_phone"))
    return cl.asof_orders(o, calls, forward=True).select(
        F.col("call_sid").alias("order_id"), F.col("started_at").alias("created_at"),
        F.col("order_id").alias("call_sid"), F.col("order_created_at").alias("started_at"))


@query("call_alerts", """
    SELECT s.call_sid, a.code, coalesce(a.n_alerts, 0) AS n_alerts
    FROM v_call_state s LEFT JOIN (
      SELECT 'CALL-' || CAST(user_id AS VARCHAR) AS call_sid, CAST(json_extract(props, '$.k') AS BIGINT) AS code,
             count(*) AS n_alerts
      FROM events WHERE event_type = 'error' GROUP BY 1, 2) a ON a.call_sid = s.call_sid""", ctes=CALL_CTES)
def q_call_alerts(spark, d):
    e = tb.read_table(spark, d, "events").filter(F.col("event_type") == "error")
    alerts = e.select(F.concat(F.lit("CALL-"), F.col("user_id").cast("string")).alias("call_sid"),
                      F.get_json_object("props", "$.k").cast("bigint").alias("code"))
    return cl.call_alerts(_state(spark, d), alerts)


@query("usable_turns", """
    SELECT conv_id, turn, role FROM v_turns
    WHERE length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) >= 2
      AND NOT regexp_matches(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), '^[.,!?_ :;-]*$')""")
def q_usable_turns(spark, d):
    return cl.usable_turns(tb.load(spark, d).turns).select("conv_id", "turn", "role")


@query("transcripts", """
    SELECT conv_id, turn, role,
           count(*) OVER w AS turns_so_far,
           sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w AS user_turns,
           sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER w AS assistant_turns,
           sum(length(text)) OVER w AS chars_so_far
    FROM v_turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING)""")
def q_transcripts(spark, d):
    return cl.transcripts(tb.load(spark, d).turns).select(
        "conv_id", "turn", "role", "turns_so_far", F.col("user_turns").cast("bigint").alias("user_turns"),
        F.col("assistant_turns").cast("bigint").alias("assistant_turns"),
        F.col("chars_so_far").cast("bigint").alias("chars_so_far"))


@query("assemble_transcripts", """
    SELECT conv_id, CAST(floor(turn / 1024) AS BIGINT) AS block, count(*) AS n_turns,
           count(*) FILTER (WHERE role = 'user') AS user_turns,
           count(*) FILTER (WHERE role = 'assistant') AS assistant_turns,
           string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS text
    FROM v_turns GROUP BY 1, 2""")
def q_assemble_transcripts(spark, d):
    return cl.assemble_transcripts(tb.load(spark, d).turns)


@query("cumulative_cart", """
    SELECT o.o_custkey AS customer, i.l_partkey AS product_id, i.l_orderkey AS order_key,
           i.l_linenumber AS line_number, CAST(i.l_quantity AS BIGINT) AS quantity,
           sum(CAST(i.l_quantity AS BIGINT)) OVER (PARTITION BY o.o_custkey, i.l_partkey
             ORDER BY o.o_orderdate, i.l_orderkey, i.l_linenumber, i.l_quantity, i.l_extendedprice, i.l_suppkey
             ROWS UNBOUNDED PRECEDING) AS cart_quantity
    FROM lineitem i JOIN orders o ON o.o_orderkey = i.l_orderkey""")
def q_cumulative_cart(spark, d):
    li = tb.read_table(spark, d, "lineitem")
    o = tb.read_table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    lines = li.join(o, "l_orderkey").select(
        F.col("o_custkey").alias("customer"), F.col("l_partkey").alias("product_id"),
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_number"),
        F.col("l_quantity").cast("bigint").alias("quantity"), "o_orderdate", "l_quantity", "l_extendedprice",
        "l_suppkey")
    out = cl.cumulative_cart(lines, ["customer", "product_id"],
                             ["o_orderdate", "order_key", "line_number", "l_quantity", "l_extendedprice",
                              "l_suppkey"], "o_orderdate")
    return out.select("customer", "product_id", "order_key", "line_number", "quantity",
                      F.col("cart_quantity").cast("bigint").alias("cart_quantity"))


FLAGS_SQL = f"""
SELECT *, last_value(CASE WHEN kind = 'bot_audio' THEN ts END IGNORE NULLS) {PREV} AS last_bot,
       coalesce(max(CASE WHEN kind = 'end' AND order_id IS NOT NULL THEN 1 ELSE 0 END) {PREV}, 0) = 1 AS locked,
       last_value(CASE WHEN kind = 'loud' THEN ts END IGNORE NULLS) {UPTO} AS last_loud
FROM v_call_events"""
FLAG_CTES = {"v_flags": FLAGS_SQL}


@query("echo_gate", f"""
    SELECT call, event_id, ts, kind, value,
           last_bot IS NOT NULL AND epoch_us(ts) - epoch_us(last_bot) < {ECHO * US} AS bot_active, locked,
           (last_bot IS NOT NULL AND epoch_us(ts) - epoch_us(last_bot) < {ECHO * US}) AND (locked OR value < 50)
             AS suppressed
    FROM v_flags WHERE kind <> 'bot_audio'""", ctes=FLAG_CTES)
def q_echo_gate(spark, d):
    return cl.echo_gate(tb.load(spark, d).call_events, ECHO)


@query("frame_gate_counters", f"""
    SELECT call, sum(CASE WHEN NOT s THEN 1 ELSE 0 END)::BIGINT AS forwarded,
           sum(CASE WHEN s THEN 1 ELSE 0 END)::BIGINT AS suppressed,
           round(sum(CASE WHEN NOT s THEN 1 ELSE 0 END) * 0.1, 1)::DOUBLE AS forwarded_seconds,
           round(sum(CASE WHEN s THEN 1 ELSE 0 END) * 0.1, 1)::DOUBLE AS suppressed_seconds
    FROM (SELECT call, (last_bot IS NOT NULL AND epoch_us(ts) - epoch_us(last_bot) < {ECHO * US})
                       AND (locked OR value < 50) AS s
          FROM v_flags WHERE kind <> 'bot_audio') GROUP BY call""", ctes=FLAG_CTES)
def q_frame_gate_counters(spark, d):
    return cl.frame_gate_counters(cl.echo_gate(tb.load(spark, d).call_events, ECHO))


@query("barge_in", f"""
    SELECT call, event_id, ts, locked,
           last_loud IS NOT NULL AND epoch_us(ts) - epoch_us(last_loud) <= {BARGE * US} AND NOT locked AS genuine
    FROM v_flags WHERE kind = 'interrupt'""", ctes=FLAG_CTES)
def q_barge_in(spark, d):
    return cl.barge_in(tb.load(spark, d).call_events, BARGE)


@query("order_lock", f"""
    SELECT call, event_id, ts, kind,
           coalesce(max(CASE WHEN kind = 'end' AND order_id IS NOT NULL THEN 1 ELSE 0 END) {PREV}, 0) = 1 AS ignored
    FROM v_call_events""")
def q_order_lock(spark, d):
    return cl.order_lock(tb.load(spark, d).call_events)


@query("chunk_energy", """
    SELECT label, count(*) AS n_chunks, round(avg(r), 6) AS mean_rms, round(max(r), 6) AS max_rms,
           round(avg(CASE WHEN r > 0.040 THEN 1.0 ELSE 0.0 END), 6) AS share_speech,
           round(avg(CASE WHEN r >= 0.18 THEN 1.0 ELSE 0.0 END), 6) AS share_loud
    FROM (SELECT label, CASE WHEN len(embedding) > 0 THEN
                 sqrt(list_reduce(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)),
                                  lambda a, b: a + b) / len(embedding)) ELSE 0.0 END AS r
          FROM embeddings) GROUP BY label""")
def q_chunk_energy(spark, d):
    return cl.chunk_energy(tb.read_table(spark, d, "embeddings"), "label", "embedding")


@query("frame_windows", """
    SELECT call, time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
           time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n_frames,
           round(avg(energy), 6) AS mean_energy, round(1.0 - avg(CASE WHEN loud THEN 1.0 ELSE 0.0 END), 6)
             AS silence_ratio
    FROM v_frames GROUP BY 1, 2, 3""")
def q_frame_windows(spark, d):
    return cl.frame_windows(tb.load(spark, d).frames, "1 hour")


@query("frame_windows_sliding", """
    SELECT call, ws AS window_start, ws + INTERVAL 6 HOUR AS window_end, count(*) AS n_frames,
           round(avg(energy), 6) AS mean_energy, round(1.0 - avg(CASE WHEN loud THEN 1.0 ELSE 0.0 END), 6)
             AS silence_ratio
    FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS ws
          FROM v_frames, range(0, 6) r(k)) GROUP BY 1, 2, 3""")
def q_frame_windows_sliding(spark, d):
    return cl.frame_windows(tb.load(spark, d).frames, "6 hours", "1 hour")


@query("dedup_calls", """
    SELECT call_sid, arg_min(ts, (ts, event_id)) AS ts, arg_min(event_id, (ts, event_id)) AS event_id
    FROM v_call_events WHERE kind = 'start' GROUP BY call_sid""")
def q_dedup_calls(spark, d):
    return cl.dedup_calls(tb.load(spark, d).call_events)
