"""Stock ledger, status transitions, cancellation and first-come allocation
(W2, W3, O1, O2, O3, A10).

Sequential rules become windows: running sums, a running minimum and
"last valid value before me".  They run through the two-level scans in
``kirana.operators.scan`` so a product or order that holds a large share
of the rows is split across tasks by time bucket instead of landing in
one window partition.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kirana.functions.phone import py_strip
from kirana.operators.scan import SPLIT_ROWS, running, running_floor_balance, time_bucket
from kirana.session import remove, written

VALID_STATUSES = ["CONFIRMED", "PREPARING", "OUT_FOR_DELIVERY", "DELIVERED", "CANCELLED"]


def stock_ledger(moves: DataFrame, opening: DataFrame, order: Sequence[str],
                 bucket_seconds: int = 86400, floors: Column | None = None) -> DataFrame:
    """Stock after every move where each step is ``max(0, stock + delta)``
    (or ``stock + delta`` where ``floors`` is false).  Moves of a product without
    an opening stay, with no balance and the reason ``unknown product``.

    ``moves``: product_id, ts, delta (+ the columns named in ``order``, a
    total order within a product).  ``opening``: product_id, opening.
    """
    m = moves.join(opening, "product_id", "left")
    out = running_floor_balance(
        m, ["product_id"], time_bucket(F.col("ts"), bucket_seconds), [F.col(c) for c in order],
        F.col("opening"), F.col("delta"), "balance", floors)
    return out.withColumn("reason", F.when(F.col("opening").isNull(), F.lit("unknown product")))


def ledger_closing(ledger: DataFrame, order: Sequence[str]) -> DataFrame:
    """Last balance per product (``max_by`` on the move order; combines map-side)."""
    return ledger.groupBy("product_id").agg(
        F.max_by("balance", F.struct(*order)).alias("closing"), F.count(F.lit(1)).alias("n_moves"))


def status_transitions(changes: DataFrame, orders: DataFrame, order: Sequence[str],
                       bucket_seconds: int = 86400) -> DataFrame:
    """Previous -> new status per change.

    ``changes``: order_id, ts, requested (+ ``order`` columns).  Invalid
    statuses are rejected and do not move the state; a valid change to an
    unknown order is ``not found``; a change to the current status is a no-op;
    every other valid jump is applied.  Order ids are compared ``upper(trim)``.
    ``step`` counts the earlier changes of the order.
    """
    c = changes.withColumn("order_id", F.upper(py_strip(F.col("order_id")))).withColumn("new_status", F.upper(py_strip(F.col("requested"))))
    c = c.withColumn("valid", F.col("new_status").isin(*VALID_STATUSES))
    c = running(c, ["order_id"], time_bucket(F.col("ts"), bucket_seconds), [F.col(x) for x in order],
                {"_prev_applied": ("last", F.when(F.col("valid"), F.col("new_status"))), "step": ("count", F.lit(1))}, inclusive=False)
    init = orders.select("order_id", F.col("status").alias("_initial"), F.lit(True).alias("_known"))
    c = c.join(init, "order_id", "left")
    prev = F.when(F.col("_known"), F.coalesce(F.col("_prev_applied"), F.col("_initial")))
    outcome = (F.when(~F.coalesce("valid", F.lit(False)), F.lit("rejected"))
               .when(F.col("_known").isNull(), F.lit("not found"))
               .when(prev == F.col("new_status"), F.lit("noop"))
               .otherwise(F.lit("changed")))
    return (c.withColumn("previous_status", prev).withColumn("outcome", outcome)
            .drop("_prev_applied", "_initial", "_known"))


def status_stock_moves(transitions: DataFrame, items: DataFrame) -> DataFrame:
    """O3 moves: X->CANCELLED returns the order's quantities (+), CANCELLED->X takes
    them again (-, floored by the ledger).  Lines are summed per (order, product)
    before they meet the transitions.  Of the columns that order an order's changes
    only ``step``, which rises with them, goes along with every product."""
    t = transitions.filter(F.col("outcome") == "changed").select(
        "order_id", "ts", "step",
        F.when(F.col("new_status") == "CANCELLED", F.lit(1))
         .when(F.col("previous_status") == "CANCELLED", F.lit(-1)).alias("sign"))
    t = t.filter(F.col("sign").isNotNull())
    per_product = items.groupBy("order_id", "product_id").agg(F.sum("quantity").alias("qty"))
    return t.join(per_product, "order_id").select(
        "product_id", "ts", "order_id", "step", (F.col("sign") * F.col("qty")).alias("delta"))


def apply_status_changes(transitions: DataFrame, items: DataFrame, products: DataFrame,
                         bucket_seconds: int = 86400) -> DataFrame:
    """O3: stock per product after replaying the stock effects of the status changes."""
    moves, _ = written(status_stock_moves(transitions, items), "status-moves")
    opening = products.select(F.col("id").alias("product_id"), F.col("stock_quantity").alias("opening"))
    led = stock_ledger(moves, opening, ["ts", "order_id", "step", "delta"], bucket_seconds, F.col("delta") < 0)
    closing = ledger_closing(led, ["ts", "order_id", "step", "delta"])
    return (opening.join(closing, "product_id", "left")
            .select("product_id", "opening", F.coalesce("closing", "opening").alias("stock"),
                    F.coalesce("n_moves", F.lit(0)).alias("n_moves")))


def cancel_orders(requests: DataFrame, orders: DataFrame, items: DataFrame,
                  order: Sequence[str]) -> DataFrame:
    """O2: a batch of cancel requests in ``order``.

    Unknown id -> error; already cancelled (before, or by an earlier request
    in the batch) -> error; any other status, DELIVERED included -> cancelled,
    and the order's quantities go back to stock (``units_restored``)."""
    r = requests.withColumn("order_id", F.upper(py_strip(F.col("requested_id"))))
    first = (r.groupBy("order_id").agg(F.min(F.struct(*order)).alias("_first")))
    r = r.join(first, "order_id").withColumn("_is_first", F.struct(*order) == F.col("_first"))
    o = orders.select("order_id", "status")
    asked = r.select("order_id").distinct()
    units = items.join(asked, "order_id", "left_semi").groupBy("order_id").agg(F.sum("quantity").alias("_units"))
    j = r.join(o, "order_id", "left").join(units, "order_id", "left")
    outcome = (F.when(F.col("status").isNull(), F.lit("not found"))
               .when((F.col("status") == "CANCELLED") | ~F.col("_is_first"), F.lit("already cancelled"))
               .otherwise(F.lit("cancelled")))
    return (j.withColumn("outcome", outcome)
            .withColumn("units_restored", F.when(F.col("outcome") == "cancelled",
                                                 F.coalesce("_units", F.lit(0))).otherwise(F.lit(0)))
            .drop("_first", "_is_first", "_units"))


def restored_stock(cancelled: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """O2 stock effect: stock + quantities of the orders actually cancelled."""
    done = cancelled.filter(F.col("outcome") == "cancelled").select("order_id").distinct()
    back = items.join(done, "order_id", "left_semi").groupBy("product_id").agg(F.sum("quantity").alias("_b"))
    return (products.join(back, products["id"] == back["product_id"], "left")
            .select("id", (F.col("stock_quantity") + F.coalesce("_b", F.lit(0))).alias("stock_quantity")))


# ---------------------------------------------------------------------------
# O1: first-come, all-or-nothing allocation
# ---------------------------------------------------------------------------

def _order_sequence(orders: DataFrame, order: Sequence[str], seq_bucket: int) -> DataFrame:
    """order_id, its place ``_o`` and the bucket ``_b`` of places it is in."""
    first = orders.schema[order[0]].dataType.typeName()
    bkt = (time_bucket(F.col(order[0]), 86400) if first in ("timestamp", "timestamp_ntz", "date")
           else F.floor(F.col(order[0]) / seq_bucket))
    return orders.select("order_id", F.struct(*order).alias("_o"), bkt.alias("_b"))


def _places_joined(per: DataFrame) -> tuple[int, bool]:
    """Buckets of places to join into one, so that the commonest product has about ``SPLIT_ROWS`` lines in each,
    and whether no product has more lines at all."""
    n, lo, hi = (per.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.min("_b").alias("lo"), F.max("_b").alias("hi"))
                 .agg(F.max("n"), F.min("lo"), F.max("hi")).first())
    return max(1, int(hi - lo + 1) // -(-n // SPLIT_ROWS)) if n and lo is not None else 1, not n or n <= SPLIT_ROWS


def allocate_orders(orders: DataFrame, lines: DataFrame, stock: DataFrame,
                    order: Sequence[str] = ("created_at", "id"), seq_bucket: int = 4096) -> DataFrame:
    """O1: accept an order iff every line's quantity fits the stock left *when the
    order starts* (each line tested alone); accepted orders take all their lines,
    rejected ones take nothing.  An order without lines, or with a line for a
    product without a stock row, is rejected.

    Exact and distributed: each round bounds every open order from the orders
    before it -- ``hi`` = demand of earlier orders not rejected, ``lo`` = demand
    of earlier accepted orders.  ``stock - hi >= qty`` on every line settles it
    as accepted, ``stock - lo < qty`` on some line as rejected.  The earliest
    open order always settles, so the loop ends when none is open; there is no
    other bound on the rounds.  A round keeps the lines of open orders with what
    earlier accepted orders left of the stock, and those of the orders it accepted,
    which the next round takes off that; they are shuffled by product and by order and
    written once, to the shared checkpoint directory, and the round before is removed.

    ``orders``: order_id + ``order`` columns; ``lines``: order_id, product_id,
    quantity; ``stock``: product_id, stock.
    Returns order_id, accepted, reason, round.
    """
    spark = orders.sparkSession
    # a place and a number stand for the columns of ``order`` and the id, which would go along with every line
    seq = _order_sequence(orders, order, seq_bucket).orderBy("_o").withColumn("_at", F.monotonically_increasing_id())
    seq = seq.select("order_id", "_b", "_at", F.min("_at").over(Window.partitionBy("order_id")).alias("_k"))
    seq, _ = written(seq, "allocate-orders")
    # one row per (order, product): the largest single line is what is tested,
    # the sum is what is deducted
    per = (lines.groupBy("order_id", "product_id")
           .agg(F.max("quantity").alias("qmax"), F.sum("quantity").alias("qsum")))
    per = per.join(seq, "order_id").join(stock, "product_id", "left").drop("order_id")
    per, path = written(per, "allocate-lines")
    joined, whole = _places_joined(per)
    asked = per.groupBy("_k").agg(F.max(F.col("stock").isNull()).alias("_bad"), F.count(F.lit(1)).alias("_lines"))
    few = (asked.agg(F.max("_lines")).first()[0] or 0) <= SPLIT_ROWS
    decided = (seq.select("_k").join(asked, "_k", "left").filter(F.coalesce("_bad", F.lit(True)))
               .select("_k", F.when(F.col("_bad"), F.lit("not found")).otherwise(F.lit("no items")).alias("reason"),
                       F.lit(0).alias("round")))
    decided, _ = written(decided, "allocate-decided")
    per = per.join(decided.select("_k"), "_k", "left_anti").withColumnRenamed("stock", "left")
    per = per.drop("_b") if whole else per.withColumn("_b", F.floor(F.col("_b") / joined))
    keep, per = per.columns, per.withColumn("all_ok", F.lit(False))
    rnd, some = 0, bool(per.limit(1).count())
    while some:
        rnd += 1
        taken = F.col("all_ok")
        # dealt by product first, the summed columns are made after the shuffle
        j = running(per.repartition("product_id") if whole else per, ["product_id"], F.lit(0) if whole else F.col("_b"), [F.col("_at")],
                    {"gone": ("sum", F.when(taken, F.col("qsum")).otherwise(0)), "ahead": ("sum", F.when(taken, 0).otherwise(F.col("qsum")))},
                    inclusive=False, whole=whole)
        j = j.filter(~taken).withColumn("left", F.col("left") - F.col("gone"))
        verdict = {"all_ok": F.min(F.col("left") - F.col("ahead") >= F.col("qmax")), "any_bad": F.max(F.col("left") < F.col("qmax")), "_head": F.min("product_id")}
        if few:
            j = j.select(*keep, *[v.over(Window.partitionBy("_k")).alias(k) for k, v in verdict.items()])
        else:
            j = j.drop("all_ok").join(j.groupBy("_k").agg(*[v.alias(k) for k, v in verdict.items()]), "_k")
            j = j.select(*keep, *verdict)
        before = path
        j, path = written(j.withColumn("_head", F.col("_head") == F.col("product_id")), "allocate-lines")
        remove(spark, before)
        dec = j.filter("_head and (all_ok or any_bad)").select(
            "_k", F.when(F.col("all_ok"), F.lit("accepted")).otherwise(F.lit("insufficient stock")).alias("reason"), F.lit(rnd).alias("round"))
        dec, _ = written(dec, "allocate-decided")
        decided = decided.unionByName(dec)
        if rnd % 16 == 0:  # keeps the plan of the union small
            decided, _ = written(decided, "allocate-decided")
        some = bool(j.filter("not coalesce(all_ok or any_bad, false)").limit(1).count())
        per = j.filter("coalesce(all_ok, false) or not coalesce(any_bad, false)").select(*keep, F.coalesce("all_ok", F.lit(False)).alias("all_ok"))
    decided = decided.join(seq.filter("_at = _k").select("_k", "order_id"), "_k")
    return decided.select("order_id", (F.col("reason") == "accepted").alias("accepted"), "reason", "round")


def allocation_certificate(decisions: DataFrame, orders: DataFrame, lines: DataFrame, stock: DataFrame,
                           order: Sequence[str] = ("created_at", "id"), seq_bucket: int = 4096) -> DataFrame:
    """Proof of O1's decisions, one row of counts.

    The stock at the start of each order is recomputed from the decisions alone
    (what earlier accepted orders took); an order is due exactly when it has lines
    and each fits.  By induction over the orders the decisions are those of the
    sequential rule if nothing is undecided, repeated or mismatched."""
    given = decisions.groupBy("order_id").agg(F.count(F.lit(1)).alias("_n"), F.max("accepted").alias("accepted"))
    seq = _order_sequence(orders, order, seq_bucket).join(given, "order_id", "left")
    per = (lines.groupBy("order_id", "product_id").agg(F.max("quantity").alias("qmax"), F.sum("quantity").alias("qsum"))
           .join(seq, "order_id").join(stock, "product_id", "left"))
    took = F.when(F.col("accepted"), F.col("qsum")).otherwise(0)
    per, _ = written(per.select("order_id", "product_id", "_o", "_b", "qmax", "stock", took.alias("took")), "certificate-lines")
    per = running(per, ["product_id"], F.col("_b"), [F.col("_o")], {"used": ("sum", F.col("took"))}, inclusive=False)
    fits = F.coalesce(F.col("stock") - F.col("used") >= F.col("qmax"), F.lit(False))
    res = seq.join(per.groupBy("order_id").agg(F.min(fits).alias("_due")), "order_id", "left")
    wrong = F.coalesce("accepted", F.lit(False)) != F.coalesce("_due", F.lit(False))
    return res.agg(F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("_due").isNull()).alias("n_without_lines"),
                   F.count_if(F.col("_n").isNull()).alias("n_undecided"), F.count_if(F.col("_n") > 1).alias("n_repeated"),
                   F.count_if(wrong).alias("n_mismatched"))


def allocation_stock(decisions: DataFrame, lines: DataFrame, stock: DataFrame) -> DataFrame:
    """Stock left after the accepted orders took all their lines."""
    acc = decisions.filter("accepted").select("order_id")
    taken = lines.join(acc, "order_id", "left_semi").groupBy("product_id").agg(F.sum("quantity").alias("_t"))
    return (stock.join(taken, "product_id", "left")
            .select("product_id", (F.col("stock") - F.coalesce("_t", F.lit(0))).alias("stock_left")))


def reconcile_stock(opening: DataFrame, items: DataFrame, orders: DataFrame,
                    closing: DataFrame) -> DataFrame:
    """A10: opening - sold (orders not cancelled) vs a closing snapshot, difference flagged."""
    live = orders.select("order_id", (F.col("status") != "CANCELLED").alias("_live"))
    sold = (items.join(live, "order_id")
            .groupBy("product_id")
            .agg(F.sum(F.when(F.col("_live"), F.col("quantity")).otherwise(0)).alias("sold"),
                 F.sum(F.when(~F.col("_live"), F.col("quantity")).otherwise(0)).alias("restored")))
    j = (opening.join(sold, "product_id", "left").join(closing, "product_id", "left")
         .select("product_id", "opening", F.coalesce("sold", F.lit(0)).alias("sold"),
                 F.coalesce("restored", F.lit(0)).alias("restored"), "closing"))
    expected = F.col("opening") - F.col("sold")
    return j.select("*", expected.alias("expected"), (F.col("closing") - expected).alias("difference"),
                    (F.col("closing") != expected).alias("flagged"))
