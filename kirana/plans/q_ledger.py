"""Registered queries: ledger, status changes, cancellation, allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kirana.functions.text import safe_quantity
from kirana.operators import ledger as lg
from kirana.plans.base import query
from kirana.plans import sql_exprs as X
from kirana.sources import tables as tb

MOVE_ORDER = ["ts", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_discount", "l_tax",
              "l_returnflag", "l_linestatus", "delta"]
CHANGE_COLS = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax",
               "l_returnflag", "l_linestatus"]


def status_changes(spark, d) -> DataFrame:
    """Status change requests bound from lineitem: R -> 'cancelled', A -> 'DELIVERED',
    N/O -> ' preparing ', N/F -> 'shipped' (not a valid status)."""
    li = tb.read_table(spark, d, "lineitem")
    req = (F.when(F.col("l_returnflag") == "R", "cancelled").when(F.col("l_returnflag") == "A", "DELIVERED")
           .when(F.col("l_linestatus") == "O", " preparing ").otherwise("shipped"))
    return li.select(F.concat(F.lit("ORD-"), F.col("l_orderkey").cast("string")).alias("order_id"),
                     F.col("l_shipdate").alias("ts"), F.struct(*CHANGE_COLS).alias("seq"), req.alias("requested"))


CHANGES_SQL = """SELECT 'ORD-' || CAST(l_orderkey AS VARCHAR) AS order_id, l_shipdate AS ts,
       l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
       CASE WHEN l_returnflag = 'R' THEN 'cancelled' WHEN l_returnflag = 'A' THEN 'DELIVERED'
            WHEN l_linestatus = 'O' THEN ' preparing ' ELSE 'shipped' END AS requested
FROM lineitem"""
CH_ORDER = "ts, " + ", ".join(CHANGE_COLS)
TRANS_SQL = f"""SELECT c.*, coalesce(c.prev_applied, o.status) AS previous_status,
       CASE WHEN NOT c.valid THEN 'rejected' WHEN o.order_id IS NULL THEN 'not found' WHEN coalesce(c.prev_applied, o.status) = c.new_status THEN 'noop'
            ELSE 'changed' END AS outcome
FROM (SELECT *, last_value(CASE WHEN valid THEN new_status END IGNORE NULLS) OVER (
               PARTITION BY order_id ORDER BY {CH_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
               AS prev_applied
      FROM (SELECT *, upper({X.strip('requested')}) AS new_status,
                   upper({X.strip('requested')}) IN ('CONFIRMED', 'PREPARING', 'OUT_FOR_DELIVERY', 'DELIVERED',
                                                     'CANCELLED') AS valid
            FROM v_changes)) c
LEFT JOIN v_orders o ON o.order_id = c.order_id"""
CTES = {"v_changes": CHANGES_SQL, "v_trans": TRANS_SQL}


def _transitions(spark, d):
    t = tb.load(spark, d)
    return lg.status_transitions(status_changes(spark, d), t.orders, ["ts", "seq"])


@query("stock_ledger", f"""
    SELECT product_id, ts, l_orderkey, l_linenumber, l_suppkey, delta, S - least(0, mn) AS balance FROM (
      SELECT *, min(S) OVER w AS mn FROM (
        SELECT m.*, p.stock_quantity + sum(m.delta) OVER w AS S FROM v_stock_moves m
        JOIN v_products p ON p.id = m.product_id
        WINDOW w AS (PARTITION BY m.product_id ORDER BY {', '.join('m.' + c for c in MOVE_ORDER)}
                     ROWS UNBOUNDED PRECEDING))
      WINDOW w AS (PARTITION BY product_id ORDER BY {', '.join(MOVE_ORDER)} ROWS UNBOUNDED PRECEDING))""")
def q_stock_ledger(spark, d):
    t = tb.load(spark, d)
    opening = t.products.select(F.col("id").alias("product_id"), F.col("stock_quantity").alias("opening"))
    return lg.stock_ledger(t.stock_moves, opening, MOVE_ORDER).select(
        "product_id", "ts", "l_orderkey", "l_linenumber", "l_suppkey", "delta", "balance")


@query("status_transitions", """
    SELECT order_id, ts, l_linenumber AS line_number, l_partkey AS part, requested, new_status, previous_status,
           outcome FROM v_trans""", ctes=CTES)
def q_status_transitions(spark, d):
    return _transitions(spark, d).select(
        "order_id", "ts", F.col("seq.l_linenumber").alias("line_number"), F.col("seq.l_partkey").alias("part"),
        "requested", "new_status", "previous_status", "outcome")


@query("apply_status_changes", f"""
    WITH mv AS (
      SELECT i.product_id, t.ts, t.order_id, {', '.join('t.' + c for c in CHANGE_COLS)},
             (CASE WHEN t.new_status = 'CANCELLED' THEN 1 ELSE -1 END) * i.qty AS delta
      FROM v_trans t JOIN (SELECT order_id, product_id, sum(quantity) AS qty FROM v_order_items
                           GROUP BY 1, 2) i ON i.order_id = t.order_id
      WHERE t.outcome = 'changed' AND (t.new_status = 'CANCELLED' OR t.previous_status = 'CANCELLED')),
    s AS (SELECT mv.*, p.stock_quantity + sum(delta) OVER w AS S,
                 row_number() OVER (PARTITION BY mv.product_id ORDER BY ts DESC, order_id DESC,
                   {', '.join(c + ' DESC' for c in CHANGE_COLS)}, delta DESC) AS rk
          FROM mv JOIN v_products p ON p.id = mv.product_id
          WINDOW w AS (PARTITION BY mv.product_id ORDER BY ts, order_id, {', '.join(CHANGE_COLS)}, delta
                       ROWS UNBOUNDED PRECEDING)),
    f AS (SELECT *, S - least(0, min(CASE WHEN delta < 0 THEN S END) OVER (PARTITION BY product_id ORDER BY ts, order_id,
                    {', '.join(CHANGE_COLS)}, delta ROWS UNBOUNDED PRECEDING)) AS bal FROM s),
    c AS (SELECT product_id, max(CASE WHEN rk = 1 THEN bal END) AS closing, count(*) AS n_moves
          FROM f GROUP BY product_id)
    SELECT p.id AS product_id, p.stock_quantity AS opening, coalesce(c.closing, p.stock_quantity) AS stock,
           coalesce(c.n_moves, 0) AS n_moves
    FROM v_products p LEFT JOIN c ON c.product_id = p.id""", ctes=CTES)
def q_apply_status_changes(spark, d):
    t = tb.load(spark, d)
    return lg.apply_status_changes(_transitions(spark, d), t.order_items, t.products)


CANCEL_REQ = """SELECT event_id, ts, 'ord-' || CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR) AS requested_id
                FROM events WHERE event_type = 'error'"""


def _cancel_requests(spark, d):
    e = tb.read_table(spark, d, "events").filter(F.col("event_type") == "error")
    return e.select("event_id", "ts", F.concat(F.lit("ord-"), F.floor(F.col("value") * 10).cast("bigint")
                                                .cast("string")).alias("requested_id"))


@query("cancel_orders", f"""
    SELECT r.event_id, r.requested_id, r.order_id, o.status,
           CASE WHEN o.status IS NULL THEN 'not found' WHEN o.status = 'CANCELLED' OR r.k > 1
                THEN 'already cancelled' ELSE 'cancelled' END AS outcome,
           CASE WHEN o.status IS NOT NULL AND o.status <> 'CANCELLED' AND r.k = 1 THEN coalesce(u.units, 0)
                ELSE 0 END AS units_restored
    FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ts, event_id) AS k
          FROM (SELECT *, upper({X.strip('requested_id')}) AS order_id FROM ({CANCEL_REQ}))) r
    LEFT JOIN v_orders o ON o.order_id = r.order_id
    LEFT JOIN (SELECT order_id, sum(quantity) AS units FROM v_order_items GROUP BY 1) u ON u.order_id = r.order_id""")
def q_cancel_orders(spark, d):
    t = tb.load(spark, d)
    return lg.cancel_orders(_cancel_requests(spark, d), t.orders, t.order_items, ["ts", "event_id"]).select(
        "event_id", "requested_id", "order_id", "status", "outcome", "units_restored")


@query("stock_reconciliation", f"""
    WITH led AS (
      SELECT product_id, S - least(0, min(S) OVER w) AS bal,
             row_number() OVER (PARTITION BY product_id ORDER BY {', '.join(c + ' DESC' for c in MOVE_ORDER)}) AS rk
      FROM (SELECT m.*, p.stock_quantity + sum(m.delta) OVER w AS S FROM v_stock_moves m
            JOIN v_products p ON p.id = m.product_id
            WINDOW w AS (PARTITION BY m.product_id ORDER BY {', '.join('m.' + c for c in MOVE_ORDER)}
                         ROWS UNBOUNDED PRECEDING))
      WINDOW w AS (PARTITION BY product_id ORDER BY {', '.join(MOVE_ORDER)} ROWS UNBOUNDED PRECEDING)),
    cl AS (SELECT product_id, max(CASE WHEN rk = 1 THEN bal END) AS closing FROM led GROUP BY 1),
    sold AS (SELECT i.product_id, sum(CASE WHEN o.status <> 'CANCELLED' THEN i.quantity ELSE 0 END) AS sold,
                    sum(CASE WHEN o.status = 'CANCELLED' THEN i.quantity ELSE 0 END) AS restored
             FROM v_order_items i JOIN v_orders o ON o.order_id = i.order_id GROUP BY 1)
    SELECT p.id AS product_id, p.stock_quantity AS opening, coalesce(s.sold, 0) AS sold,
           coalesce(s.restored, 0) AS restored, cl.closing,
           p.stock_quantity - coalesce(s.sold, 0) AS expected,
           cl.closing - (p.stock_quantity - coalesce(s.sold, 0)) AS difference,
           cl.closing <> (p.stock_quantity - coalesce(s.sold, 0)) AS flagged
    FROM v_products p LEFT JOIN sold s ON s.product_id = p.id LEFT JOIN cl ON cl.product_id = p.id""")
def q_stock_reconciliation(spark, d):
    t = tb.load(spark, d)
    opening = t.products.select(F.col("id").alias("product_id"), F.col("stock_quantity").alias("opening"))
    led = lg.stock_ledger(t.stock_moves, opening, MOVE_ORDER)
    closing = lg.ledger_closing(led, MOVE_ORDER).select("product_id", "closing")
    return lg.reconcile_stock(opening, t.order_items, t.orders, closing)


def allocation_inputs(spark, d, stock_multiplier: int = 20):
    t = tb.load(spark, d)
    orders = t.orders.select("order_id", "created_at", "id")
    lines = t.order_items.select("order_id", "product_id", safe_quantity(F.col("quantity")).alias("quantity"))
    stock = t.products.select(F.col("id").alias("product_id"),
                              (F.col("stock_quantity") * stock_multiplier).alias("stock"))
    return orders, lines, stock


@query("allocate_orders", note="iterative fixpoint: rows-only; tested against a sequential simulation")
def q_allocate_orders(spark, d):
    orders, lines, stock = allocation_inputs(spark, d)
    return lg.allocate_orders(orders, lines, stock, ("created_at", "id"))


@query("allocation_certificate", """
    SELECT (SELECT count(*) FROM v_orders) AS n_orders,
           (SELECT count(*) FROM v_orders o WHERE NOT EXISTS
              (SELECT 1 FROM v_order_items i WHERE i.order_id = o.order_id)) AS n_without_lines,
           0::BIGINT AS n_undecided, 0::BIGINT AS n_repeated, 0::BIGINT AS n_mismatched""")
def q_allocation_certificate(spark, d):
    orders, lines, stock = allocation_inputs(spark, d)
    decisions = lg.allocate_orders(orders, lines, stock, ("created_at", "id"))
    return lg.allocation_certificate(decisions, orders, lines, stock, ("created_at", "id"))
