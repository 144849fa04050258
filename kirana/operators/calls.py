"""Call event streams as batch operators (W4-W9, T5-T7 batch twins, A8, A12, A13,
J5-J7, FIL4, FIL8).

Every rule that the reference evaluates frame by frame ("last loud frame",
"bot audio in the last 0.8 s", "an order was placed earlier") is a running
aggregate over the call's timeline.  They go through the two-level scans
of ``kirana.operators.scan`` keyed by call and split by time bucket, so a
call with a third of all frames still spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kirana.functions.phone import py_strip, with_phone_keys
from kirana.functions.text import PUNCT_ONLY, rms
from kirana.operators.scan import running, time_bucket

HOUR = 3600


def _elapsed_us(later, earlier):
    """Exact elapsed microseconds (integer arithmetic, no float rounding)."""
    return F.unix_micros(later) - F.unix_micros(earlier)


def _us(seconds: float):
    return F.lit(int(round(seconds * 1_000_000)))


def _in_segments(frames: DataFrame, gap_seconds: float, bucket_seconds: int) -> DataFrame:
    """Frames inside a turn, with ``seg`` (its number in the call) and ``closes``.

    The silent frames since the last loud one are closed by the first that is
    ``gap_seconds`` late, so a turn is already closed before a frame when the
    frame just before it was that late."""
    bkt = time_bucket(F.col("ts"), bucket_seconds)
    order = [F.col("ts"), F.col("event_id")]
    f = running(frames, ["call"], bkt, order,
                {"prev_loud": ("last", F.when(F.col("loud"), F.col("ts"))),
                 "prev_ts": ("last", F.when(F.col("loud").isNotNull(), F.col("ts")))}, inclusive=False)
    late = _elapsed_us(F.col("prev_ts"), F.col("prev_loud"))
    spent = F.coalesce((late >= _us(gap_seconds)) & (late > 0), F.lit(False))
    f = f.withColumns({
        "closes": (~F.col("loud") & F.col("prev_loud").isNotNull()
                   & (_elapsed_us(F.col("ts"), F.col("prev_loud")) >= _us(gap_seconds))),
        "_new": F.col("loud") & (F.col("prev_loud").isNull() | spent),
        "_in": F.col("loud") | (F.col("prev_loud").isNotNull() & ~spent)})
    f = running(f, ["call"], bkt, order, {"seg": ("sum", F.col("_new").cast("int"))}, inclusive=True)
    return f.filter("_in")


def _segments_of(frames: DataFrame) -> DataFrame:
    return frames.groupBy("call", "seg").agg(
        F.min(F.when(F.col("loud"), F.col("ts"))).alias("start_ts"),
        F.max(F.when(F.col("loud"), F.col("ts"))).alias("last_loud_ts"),
        F.min(F.when(F.col("closes"), F.col("ts"))).alias("end_ts"),
        F.sum(F.col("loud").cast("int")).cast("bigint").alias("n_loud"),
        F.count(F.lit(1)).alias("n_frames"))


def _long_enough(segs: DataFrame, min_loud_seconds: float) -> DataFrame:
    return segs.filter(_elapsed_us(F.col("last_loud_ts"), F.col("start_ts")) >= _us(min_loud_seconds))


def speech_segments(frames: DataFrame, gap_seconds: float, min_loud_seconds: float = 0.0,
                    bucket_seconds: int = 86400) -> DataFrame:
    """Turns from a frame stream.

    ``frames``: call, ts, event_id, loud.  A turn starts at a loud frame and
    closes at the first silent frame at least ``gap_seconds`` after the last
    loud frame (the closing frame is part of the turn).  Open turns at the
    end of a call are emitted with ``closed = false``.  ``min_loud_seconds``
    drops turns whose loud span is shorter.
    """
    segs = _segments_of(_in_segments(frames, gap_seconds, bucket_seconds))
    return _long_enough(segs.withColumn("closed", F.col("end_ts").isNotNull()), min_loud_seconds)


def frame_batches(frames: DataFrame, n: int = 5, bucket_seconds: int = 86400) -> DataFrame:
    """Every ``n`` consecutive frames of a call form one batch; an incomplete
    tail is held back."""
    f = running(frames, ["call"], time_bucket(F.col("ts"), bucket_seconds), [F.col("ts"), F.col("event_id")],
                {"_rn": ("count", F.lit(1))}, inclusive=True)
    f = f.withColumn("batch", F.floor((F.col("_rn") - 1) / n).cast("bigint"))
    return (f.groupBy("call", "batch")
            .agg(F.count(F.lit(1)).alias("n_frames"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
                 F.round(F.avg("energy"), 6).alias("mean_energy"))
            .filter(F.col("n_frames") == n))


def call_starts(events: DataFrame) -> DataFrame:
    """First event time per call (an aggregate, combined map-side)."""
    return events.groupBy("call").agg(F.min("ts").alias("call_start"))


def warmup_discard(frames: DataFrame, skip_seconds: float) -> DataFrame:
    """Drop frames in the first ``skip_seconds`` of each call."""
    s = call_starts(frames)
    return (frames.join(s, "call")
            .filter(_elapsed_us(F.col("ts"), F.col("call_start")) >= _us(skip_seconds)).drop("call_start"))


def latest_call_state(events: DataFrame) -> DataFrame:
    """One row per call from its start/end events.

    Status follows the latest start/end event (start -> IN_PROGRESS, end ->
    COMPLETED); duration is ``greatest(0, int(d))`` of the latest end; the order
    id is the last non-null one; the summary follows the latest end.  All
    ``max_by`` aggregates, so hot calls combine map-side."""
    se = events.filter(F.col("kind").isin("start", "end"))
    okey = F.struct("ts", "event_id")
    is_end = F.col("kind") == "end"
    agg = se.groupBy("call_sid", "call").agg(
        F.max_by("kind", okey).alias("_last_kind"),
        F.max_by(F.when(is_end, F.col("duration")), F.when(is_end, okey)).alias("_dur"),
        F.max_by("order_id", F.when(F.col("order_id").isNotNull(), okey)).alias("order_id"),
        F.max_by(F.col("order_id"), F.when(is_end, okey)).alias("_last_end_order"),
        F.min(F.when(F.col("kind") == "start", F.col("ts"))).alias("started_at"),
        F.max(F.when(is_end, F.col("ts"))).alias("ended_at"),
        F.sum(F.when(F.col("kind") == "start", 1).otherwise(0)).cast("bigint").alias("n_starts"),
        F.sum(F.when(is_end, 1).otherwise(0)).cast("bigint").alias("n_ends"))
    status = F.when(F.col("_last_kind") == "end", F.lit("COMPLETED")).otherwise(F.lit("IN_PROGRESS"))
    summary = (F.when(F.col("_dur").isNull() & F.col("ended_at").isNull(), F.lit(None).cast("string"))
               .when(F.col("_last_end_order").isNotNull(),
                     F.concat(F.lit("Order "), F.col("_last_end_order"), F.lit(" placed")))
               .otherwise(F.lit("Call completed")))
    return agg.select("call_sid", "call", status.alias("call_status"),
                      F.coalesce(F.greatest(F.lit(0), F.col("_dur").cast("bigint")), F.lit(0)).alias("duration_seconds"),
                      "order_id", summary.alias("summary"), "started_at", "ended_at", "n_starts", "n_ends")


def call_outcomes(calls: DataFrame) -> DataFrame:
    """Calls by status: count, total/average duration, share with an order."""
    return calls.groupBy("call_status").agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.sum("duration_seconds").alias("total_seconds"),
        F.round(F.avg("duration_seconds"), 4).alias("avg_seconds"),
        F.round(F.avg(F.col("order_id").isNotNull().cast("double")), 6).alias("share_with_order"))


def recent_calls(calls: DataFrame, n: int = 50) -> DataFrame:
    """FIL4: the last ``n`` calls (newest start first; call id breaks ties)."""
    return calls.orderBy(F.desc("started_at"), F.desc("call_sid")).limit(n)


def call_orders(calls: DataFrame, orders: DataFrame) -> DataFrame:
    """Call -> order by the stored order id (left join, missing allowed)."""
    o = orders.select("order_id", F.col("status").alias("order_status"), "total_amount",
                      F.lit(True).alias("_found"))
    return (calls.join(o, "order_id", "left")
            .withColumn("order_found", F.coalesce("_found", F.lit(False))).drop("_found"))


def asof_orders(calls: DataFrame, orders: DataFrame, call_phone: str = "caller_phone",
                order_phone: str = "customer_phone", tolerance_seconds: float | None = None,
                bucket_seconds: int = 30 * 86400, forward: bool = False) -> DataFrame:
    """For each call, the latest order by the same normalised phone placed at or
    before the call start; with ``forward`` the earliest at or after it (within
    ``tolerance_seconds`` when given).  Of orders at one time the larger id
    counts as later.

    Calls and orders are unioned into one timeline per phone and the latest
    order is carried forward with a running ``last`` (``forward``: the timeline
    runs backwards) -- no pairs are formed, so a phone with many calls and many
    orders stays linear."""
    c = with_phone_keys(calls, call_phone, "_c").select(
        F.col("_c_norm").alias("_key"), F.col("call_sid"), F.col("started_at").alias("_ts"),
        F.lit(1).alias("_side"), F.lit(None).cast("string").alias("_oid"),
        F.lit(None).cast("timestamp").alias("_ots"))
    o = with_phone_keys(orders, order_phone, "_o").select(
        F.col("_o_norm").alias("_key"), F.lit(None).cast("string").alias("call_sid"),
        F.col("created_at").alias("_ts"), F.lit(0).alias("_side"), F.col("order_id").alias("_oid"),
        F.col("created_at").alias("_ots"))
    if forward:  # of orders at one time the earliest counts
        o = (o.groupBy("_key", "_ts").agg(F.min("_oid").alias("_oid"))
             .select("_key", F.lit(None).cast("string").alias("call_sid"), "_ts", F.lit(0).alias("_side"), "_oid",
                     F.col("_ts").alias("_ots")))
    tl = c.unionByName(o).filter(F.col("_key") != "")
    way = F.lit(-1 if forward else 1)
    tl = running(tl, ["_key"], way * time_bucket(F.col("_ts"), bucket_seconds),
                 [way * F.unix_micros("_ts"), F.col("_side"), F.col("_oid"), F.col("call_sid")],
                 {"_last": ("last", F.when(F.col("_side") == 0, F.struct("_ots", "_oid")))}, inclusive=True)
    # a call without a phone number has no order
    lone = c.filter(F.coalesce("_key", F.lit("")) == "").select(
        "call_sid", F.col("_ts").alias("started_at"), F.lit(None).cast("string").alias("order_id"),
        F.lit(None).cast("timestamp").alias("order_created_at"))
    hit = tl.filter(F.col("_side") == 1)
    ok = F.col("_last").isNotNull()
    if tolerance_seconds is not None:
        ok = ok & (F.abs(_elapsed_us(F.col("_ts"), F.col("_last._ots"))) <= _us(tolerance_seconds))
    return hit.select("call_sid", F.col("_ts").alias("started_at"),
                      F.when(ok, F.col("_last._oid")).alias("order_id"),
                      F.when(ok, F.col("_last._ots")).alias("order_created_at")).unionByName(lone)


def call_alerts(calls: DataFrame, alerts: DataFrame) -> DataFrame:
    """Calls with their alerts per code (calls without alerts kept), pre-aggregated
    per (call, code) before the join."""
    a = alerts.groupBy("call_sid", "code").agg(F.count(F.lit(1)).alias("n_alerts"))
    return (calls.select("call_sid").join(a, "call_sid", "left")
            .withColumn("n_alerts", F.coalesce("n_alerts", F.lit(0))))


def usable_turns(turns: DataFrame, text_col: str = "text", min_chars: int = 2,
                 duration_col: str | None = None, min_seconds: float = 0.4) -> DataFrame:
    """FIL8: drop turns shorter than ``min_seconds`` (when a duration exists), with
    fewer than ``min_chars`` characters, or made only of punctuation."""
    s = py_strip(F.coalesce(F.col(text_col), F.lit("")))
    keep = (F.length(s) >= min_chars) & ~s.rlike(PUNCT_ONLY)
    if duration_col:
        keep = keep & (F.col(duration_col) >= min_seconds)
    return turns.filter(keep)


def transcripts(turns: DataFrame, bucket_turns: int = 1024) -> DataFrame:
    """Turns in order per conversation with the running context: turns,
    user and assistant turns and characters so far (two-level running counts)."""
    t = turns.withColumn("_len", F.length("text").cast("bigint"))
    return running(t, ["conv_id"], F.floor(F.col("turn") / bucket_turns), [F.col("turn"), F.col("role")],
                   {"turns_so_far": ("count", F.lit(1)),
                    "user_turns": ("sum", (F.col("role") == "user").cast("bigint")),
                    "assistant_turns": ("sum", (F.col("role") == "assistant").cast("bigint")),
                    "chars_so_far": ("sum", F.col("_len"))}, inclusive=True).drop("_len")


def assemble_transcripts(turns: DataFrame, block_turns: int = 1024) -> DataFrame:
    """The text of each conversation, a ``role: text`` line per turn in order, with counts.

    One row per conversation and block of ``block_turns`` turn numbers, so that a
    row stays bounded however long a conversation is; the blocks in order are the
    whole.  Null roles and texts count as empty, turns of one number go by role
    and text."""
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    line = F.transform("_said", lambda t: F.concat(t["role"], F.lit(": "), t["text"]))
    return (turns.groupBy("conv_id", F.floor(F.col("turn") / block_turns).alias("block"))
            .agg(F.sort_array(F.collect_list(said)).alias("_said"), F.count(F.lit(1)).alias("n_turns"),
                 F.count_if(F.col("role") == "user").alias("user_turns"),
                 F.count_if(F.col("role") == "assistant").alias("assistant_turns"))
            .select("conv_id", "block", "n_turns", "user_turns", "assistant_turns", F.array_join(line, "\n").alias("text")))


def cumulative_cart(lines: DataFrame, by: list[str], order: list[str], ts: str,
                    bucket_seconds: int = 30 * 86400) -> DataFrame:
    """Running quantity per (caller, product) over the turns / orders."""
    return running(lines, by, time_bucket(F.col(ts), bucket_seconds), [F.col(c) for c in order],
                   {"cart_quantity": ("sum", F.col("quantity"))}, inclusive=True)


def _is_order():
    return (F.col("kind") == "end") & F.col("order_id").isNotNull()


def timeline_flags(events: DataFrame, bucket_seconds: int = 86400) -> DataFrame:
    """Running state used by T5-T7 on the merged call timeline.

    Adds ``last_bot`` (latest bot audio strictly before), ``last_loud`` (latest
    loud speech at or before) and ``locked`` (an order was placed earlier)."""
    loud = F.when(F.col("kind") == "loud", F.col("ts"))
    e = running(events, ["call"], time_bucket(F.col("ts"), bucket_seconds), [F.col("ts"), F.col("event_id")],
                {"last_bot": ("last", F.when(F.col("kind") == "bot_audio", F.col("ts"))),
                 "last_loud": ("last", loud), "locked": ("max", _is_order().cast("int"))}, inclusive=False)
    return e.withColumns({"last_loud": F.coalesce(loud, "last_loud"), "locked": F.coalesce("locked", F.lit(0)) == 1})


def echo_gate(events: DataFrame, echo_seconds: float, loud_at: float = 50.0,
              bucket_seconds: int = 86400) -> DataFrame:
    """T5: a caller frame is suppressed while bot audio was sent within
    ``echo_seconds`` unless it is loud and no order has been placed."""
    e = timeline_flags(events, bucket_seconds)
    bot_active = F.col("last_bot").isNotNull() & (_elapsed_us(F.col("ts"), F.col("last_bot")) < _us(echo_seconds))
    suppressed = bot_active & (F.col("locked") | (F.col("value") < loud_at))
    return (e.filter(F.col("kind") != "bot_audio")
            .select("call", "event_id", "ts", "kind", "value", bot_active.alias("bot_active"),
                    "locked", suppressed.alias("suppressed")))


def frame_gate_counters(gated: DataFrame, seconds_per_frame: float = 0.1) -> DataFrame:
    """Per call, frames forwarded / suppressed and their seconds."""
    return gated.groupBy("call").agg(
        F.sum(F.when(~F.col("suppressed"), 1).otherwise(0)).cast("bigint").alias("forwarded"),
        F.sum(F.when(F.col("suppressed"), 1).otherwise(0)).cast("bigint").alias("suppressed")
    ).select("call", "forwarded", "suppressed",
             F.round(F.col("forwarded") * seconds_per_frame, 1).alias("forwarded_seconds"),
             F.round(F.col("suppressed") * seconds_per_frame, 1).alias("suppressed_seconds"))


def barge_in(events: DataFrame, window_seconds: float, bucket_seconds: int = 86400) -> DataFrame:
    """An interrupt is genuine when loud speech happened at most
    ``window_seconds`` before it and no order has been placed."""
    e = timeline_flags(events, bucket_seconds)
    recent = F.col("last_loud").isNotNull() & (_elapsed_us(F.col("ts"), F.col("last_loud")) <= _us(window_seconds))
    return (e.filter(F.col("kind") == "interrupt")
            .select("call", "event_id", "ts", "locked", (recent & ~F.col("locked")).alias("genuine")))


def order_lock(events: DataFrame, bucket_seconds: int = 86400) -> DataFrame:
    """After an order event in a call, later interrupts and frames are ignored."""
    return timeline_flags(events, bucket_seconds).select("call", "event_id", "ts", "kind", F.col("locked").alias("ignored"))


def chunk_energy(chunks: DataFrame, key: str, arr: str, quiet: float = 0.040,
                 loud: float = 0.18) -> DataFrame:
    """RMS per chunk (array HOFs, no UDF), then per-key mean/max and the
    share of chunks above the speech and barge-in thresholds."""
    c = chunks.select(key, rms(F.col(arr)).alias("_rms"))
    return c.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.round(F.avg("_rms"), 6).alias("mean_rms"),
        F.round(F.max("_rms"), 6).alias("max_rms"),
        F.round(F.avg((F.col("_rms") > quiet).cast("double")), 6).alias("share_speech"),
        F.round(F.avg((F.col("_rms") >= loud).cast("double")), 6).alias("share_loud"))


def frame_windows(frames: DataFrame, size: str, slide: str | None = None, loud_col: str = "loud") -> DataFrame:
    """T11 (batch): tumbling (or sliding) time windows of frame energy per call."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (frames.groupBy("call", w.alias("w"))
            .agg(F.count(F.lit(1)).alias("n_frames"), F.round(F.avg("energy"), 6).alias("mean_energy"),
                 F.round(1.0 - F.avg(F.col(loud_col).cast("double")), 6).alias("silence_ratio"))
            .select("call", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "n_frames", "mean_energy", "silence_ratio"))


def dedup_calls(events: DataFrame) -> DataFrame:
    """T10 (batch): one start record per call id (earliest start)."""
    s = events.filter(F.col("kind") == "start")
    return s.groupBy("call_sid").agg(F.min(F.struct("ts", "event_id")).alias("_f")).select(
        "call_sid", F.col("_f.ts").alias("ts"), F.col("_f.event_id").alias("event_id"))
