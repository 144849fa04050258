"""Structured Streaming forms of the call and store operators.

* windowed aggregations with a watermark (T9, T11, session windows): state is dropped
  once the watermark passes;
* interval joins of watermarked streams (T6), duplicates within a watermark (T10);
* rules that depend on what a key did before (T1-T5, T7, T8): Spark's keyed state with
  timers, fed in order of event time (``keyed.py``);
* the keyed aggregation for an ``update`` sink that keeps the earliest start (T10).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kirana.operators import calls as cl
from kirana.streaming.keyed import ROCKS, in_order


def _live(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermark on ``ts`` then drop the replay's flush sentinel; state outside the executors' heap."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    w = df.withWatermark(ts, delay)
    # the predicate references the event-time column, so Catalyst does not push it
    # below the watermark node: the sentinel still advances the watermark
    # (a disjunction is not split into separately pushable conjuncts)
    return w.filter(~F.col("_flush") | F.col(ts).isNull()) if "_flush" in df.columns else w


def stream_daily_kpis(orders: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Daily order KPIs on a tumbling 1-day window, emitted when the day closes."""
    o = _live(orders, "created_at", lateness)
    live = F.col("status") != "CANCELLED"
    return (o.groupBy(F.window("created_at", "1 day").alias("w"))
            .agg(F.count(F.lit(1)).alias("orders"),
                 F.sum(F.when(live, 1).otherwise(0)).cast("bigint").alias("live_orders"),
                 F.sum(F.when(live, F.col("total_amount")).otherwise(0.0).cast("decimal(18,2)")).alias("_rev"))
            .select(F.to_date(F.col("w.start")).alias("day"), "orders", "live_orders",
                    F.round(F.col("_rev").cast("decimal(38,6)"), 2).cast("double").alias("revenue")))


def stream_dedup_calls(events: DataFrame) -> DataFrame:
    """One start record per call id although starts are logged twice: the earliest
    start, for an ``update`` sink that upserts by call id."""
    return cl.dedup_calls(events)


def stream_speech_sessions(frames: DataFrame, gap: str, lateness: str = "1 day") -> DataFrame:
    """Loud frames grouped into session windows per call; T2 proper, with W4's rule
    for the closing frame, is ``stream_speech_segments``."""
    # references the event-time column so it is not pushed below the watermark
    f = _live(frames, "ts", lateness).filter(F.col("loud") | F.col("ts").isNull())
    return (f.groupBy("call", F.session_window("ts", gap).alias("s"))
            .agg(F.count(F.lit(1)).alias("n_loud"), F.min("ts").alias("start_ts"), F.max("ts").alias("last_loud_ts")))


def stream_frame_windows(frames: DataFrame, size: str = "1 hour", slide: str | None = None,
                         lateness: str = "1 day") -> DataFrame:
    """Tumbling or sliding windows of frame energy per call."""
    return cl.frame_windows(_live(frames, "ts", lateness), size, slide)


def _as_times(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.timestamp_micros(F.col(c)) for c in columns})


def stream_warmup(frames: DataFrame, skip_seconds: float, lateness: str = "1 day") -> DataFrame:
    """Drop each call's frames in the first ``skip_seconds``.  State: the first time."""
    skip = int(round(skip_seconds * 1_000_000))

    def rule(state, row):
        first = state[0] if state else row["_us"]
        return (first,), [(row["event_id"], row["_us"])] if row["_us"] - first >= skip else []

    out = in_order(frames, "call", "ts", ["event_id"], [], rule, "event_id bigint, ts bigint", lateness)
    return _as_times(out, "ts")


def stream_speech_segments(frames: DataFrame, gap_seconds: float, min_loud_seconds: float = 0.0, lateness: str = "1 day") -> DataFrame:
    """The turns of W4, each emitted when it closes.  State: the last loud and the last frame, and the open turn."""
    gap, least = (int(round(x * 1_000_000)) for x in (gap_seconds, min_loud_seconds))

    def rule(state, row):
        loud_us, prev_us, seg, start, n_loud, n_frames = state or (None, None, 0, None, 0, 0)
        us, made = row["_us"], []
        spent = loud_us is not None and prev_us - loud_us >= gap and prev_us > loud_us
        if row["loud"] and (loud_us is None or spent):
            seg, start, n_loud, n_frames = seg + 1, us, 0, 0
        if row["loud"] or loud_us is not None and not spent:
            n_loud, n_frames = n_loud + bool(row["loud"]), n_frames + 1
            if not row["loud"] and us - loud_us >= gap and loud_us - start >= least:
                made = [(seg, start, loud_us, us, n_loud, n_frames)]
        return (us if row["loud"] else loud_us, us, seg, start, n_loud, n_frames), made

    out = in_order(frames, "call", "ts", ["event_id"], ["loud"], rule,
                   "seg bigint, start_ts bigint, last_loud_ts bigint, end_ts bigint, n_loud bigint, n_frames bigint", lateness)
    return _as_times(out, "start_ts", "last_loud_ts", "end_ts")


def stream_batches(frames: DataFrame, n: int = 5, lateness: str = "1 day") -> DataFrame:
    """T4: every ``n`` consecutive frames of a call form one batch; the tail waits.  State: its frames' energies."""
    def rule(state, row):
        done, first, energies = state or (0, None, [])
        energies = [*energies, row["energy"]]
        first = row["_us"] if len(energies) == 1 else first
        if len(energies) < n:
            return (done, first, energies), []
        known = [e for e in energies if e is not None]
        return (done + 1, None, []), [(done, n, first, row["_us"], sum(known) / len(known) if known else None)]

    out = in_order(frames, "call", "ts", ["event_id"], ["energy"], rule,
                   "batch_no bigint, n_frames bigint, first_ts bigint, last_ts bigint, mean_energy double", lateness)
    return _as_times(out.withColumn("mean_energy", F.round("mean_energy", 6)), "first_ts", "last_ts")


def _timeline(state, row):
    """Bot audio and order lock before an event, loud speech up to it, and the state after it."""
    bot, loud, locked = state or (None, None, False)
    loud = row["_us"] if row["kind"] == "loud" else loud
    after = (row["_us"] if row["kind"] == "bot_audio" else bot, loud, locked or row["kind"] == "end" and row["order_id"] is not None)
    return bot, loud, locked, after


def stream_echo_gate(events: DataFrame, echo_seconds: float, loud_at: float = 50.0, lateness: str = "1 day") -> DataFrame:
    """T5: echo gate on a stream of call events.  State: the last bot audio and whether an order was placed."""
    echo = int(round(echo_seconds * 1_000_000))

    def rule(state, row):
        bot, _, locked, after = _timeline(state, row)
        if row["kind"] == "bot_audio":
            return after, []
        active = bot is not None and row["_us"] - bot < echo
        quiet = None if row["value"] is None else row["value"] < loud_at
        return after, [(row["event_id"], row["_us"], row["kind"], row["value"], active, locked, active and (locked or quiet))]

    out = in_order(events, "call", "ts", ["event_id"], ["kind", "value", "order_id"], rule,
                   "event_id bigint, ts bigint, kind string, value double, bot_active boolean, locked boolean, suppressed boolean", lateness)
    return _as_times(out, "ts")


def stream_order_lock(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Events after an order, on a stream of call events.  State: whether an order was placed."""
    def rule(state, row):
        _, _, locked, after = _timeline(state, row)
        return after, [(row["event_id"], row["_us"], row["kind"], locked)]

    out = in_order(events, "call", "ts", ["event_id"], ["kind", "order_id"], rule, "event_id bigint, ts bigint, kind string, ignored boolean", lateness)
    return _as_times(out, "ts")


def stream_barge_in(events: DataFrame, window_seconds: float, call_seconds: float, lateness: str = "1 day") -> DataFrame:
    """T6 as interval joins of three streams: interrupts, loud speech at most ``window_seconds``
    before, and orders placed at most ``call_seconds`` before (the longest that a call lasts).

    All sides are watermarked: loud speech is dropped from the state after the window and
    the lateness, orders after the call's length, interrupts once no match can come."""
    live = _live(events, "ts", lateness)

    def side(kind: Column, name: str) -> DataFrame:
        return live.filter(kind | F.col("ts").isNull()).select(F.col("call").alias(f"{name}_call"), F.col("ts").alias(f"{name}_ts"), F.col("event_id").alias(f"{name}_id"))

    def within(name: str, seconds: float) -> Column:
        at, by = F.col("ts"), F.col(f"{name}_ts")
        return (F.col("call") == F.col(f"{name}_call")) & (by <= at) & (by >= at - F.expr(f"INTERVAL {int(round(seconds * 1_000_000))} MICROSECOND"))

    asks = live.filter((F.col("kind") == "interrupt") | F.col("ts").isNull()).select("call", "event_id", "ts")
    loud = side(F.col("kind") == "loud", "loud")
    order = side((F.col("kind") == "end") & F.col("order_id").isNotNull(), "order")
    # an order of the same moment counts if its event comes first
    first = (F.col("order_ts") < F.col("ts")) | (F.col("order_id") < F.col("event_id"))
    # after a join only the interrupt's time stays an event time
    spoke = asks.join(loud, within("loud", window_seconds), "left_outer").select("call", "event_id", "ts", F.col("loud_id").isNotNull().alias("_loud"))
    both = spoke.join(order, within("order", call_seconds) & first, "left_outer").select("call", "event_id", "ts", "_loud", F.col("order_id").isNotNull().alias("_order"))
    return (both.groupBy("ts", "call", "event_id").agg(F.max("_loud").alias("_loud"), F.max("_order").alias("locked"))
            .select("call", "event_id", "ts", "locked", (F.col("_loud") & ~F.col("locked")).alias("genuine")))


def stream_stock_ledger(moves: DataFrame, order: list[str], lateness: str = "1 day") -> DataFrame:
    """Floored stock ledger on a stream of moves (with an ``opening`` column).  State: the
    balance.  Moves of a product without an opening stay, with no balance and the reason
    ``unknown product``."""
    ties = [c for c in order if c not in ("ts", "product_id")]
    kinds = dict(moves.dtypes)

    def rule(state, row):
        now = state[0] if state else row["opening"]
        now = None if now is None else max(0, now + row["delta"])
        return (now,), [(row["_us"], *[row[c] for c in ties], now, None if now is not None else "unknown product")]

    columns = ", ".join(f"{c} {kinds[c]}" for c in ties)
    out = in_order(moves, "product_id", "ts", ties, ["opening"], rule, f"ts bigint, {columns}, balance bigint, reason string", lateness)
    return _as_times(out, "ts")


def stream_call_state(events: DataFrame, lateness: str = "1 day", idle: float = 3650 * 86400.0) -> DataFrame:
    """The state of a call (W7) after each of its start and end events, in order of
    event time, so that a late start resets nothing; ``at`` and ``event_id`` order a call's
    rows, and a sink keeps the last.  The state goes when the call has been idle so long."""
    def rule(state, row):
        _, dur, order_id, end_order, started, ended, n_starts, n_ends = state or (None, None, None, None, None, None, 0, 0)
        order_id = row["order_id"] if row["order_id"] is not None else order_id
        if row["kind"] == "end":
            dur, end_order, ended, n_ends = row["duration"], row["order_id"], row["_us"], n_ends + 1
        else:
            started, n_starts = started if started is not None else row["_us"], n_starts + 1
        after = (row["kind"], dur, order_id, end_order, started, ended, n_starts, n_ends)
        return after, [(row["call_sid"], row["_us"], row["event_id"], *after)]

    fields = "kind string, dur double, order_id string, end_order string, started_at bigint, ended_at bigint, n_starts bigint, n_ends bigint"
    out = in_order(events, "call", "ts", ["event_id"], ["call_sid", "kind", "duration", "order_id"], rule,
                   f"call_sid string, at bigint, event_id bigint, {fields}", lateness, idle, F.col("kind").isin("start", "end"))
    status = F.when(F.col("kind") == "end", F.lit("COMPLETED")).otherwise(F.lit("IN_PROGRESS"))
    summary = (F.when(F.col("ended_at").isNull(), F.lit(None).cast("string"))
               .when(F.col("end_order").isNotNull(), F.concat(F.lit("Order "), F.col("end_order"), F.lit(" placed"))).otherwise(F.lit("Call completed")))
    return _as_times(out.withColumns({"call_status": status, "summary": summary, "duration_seconds": F.coalesce(F.greatest(F.lit(0), F.col("dur").cast("bigint")), F.lit(0))}),
                     "at", "started_at", "ended_at").drop("kind", "dur", "end_order")


def latest_rows(rows: DataFrame, key: str) -> DataFrame:
    """The last row of each call of ``stream_call_state``, as a sink that upserts by call holds it."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct("at", "event_id")).alias("r")).select(key, "r.*")


def stream_dedup_starts(events: DataFrame, keys: list[str], within: str = "10 minutes") -> DataFrame:
    """One start per call although starts are logged twice, where the second comes
    within ``within`` of the first.  State: the keys of that long, so it doesn't grow with the stream."""
    live = _live(events, "ts", within)
    return live.filter((F.col("kind") == "start") | F.col("ts").isNull()).dropDuplicatesWithinWatermark(keys)
