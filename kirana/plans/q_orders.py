"""Registered queries: orders, lines, listings and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from kirana.operators import orders as od
from kirana.plans.base import query
from kirana.plans import sql_exprs as X
from kirana.sources import tables as tb
from kirana.sources.settings import settings_frame

FEE, THRESHOLD, ETA = "30.0", "200000.0", "40"

S_CTE = {"v_settings": f"""SELECT * FROM (VALUES ('delivery_fee', '{FEE}'),
          ('free_delivery_threshold', '{THRESHOLD}'), ('default_eta_minutes', '{ETA}')) s(key, value)"""}
SET_ROW = """(SELECT max(CASE WHEN key = 'delivery_fee' THEN TRY_CAST(value AS DOUBLE) END) AS fee,
                     max(CASE WHEN key = 'free_delivery_threshold' THEN TRY_CAST(value AS DOUBLE) END) AS threshold,
                     max(CASE WHEN key = 'default_eta_minutes' THEN TRY_CAST(value AS INTEGER) END) AS eta
              FROM v_settings)"""


def _t(spark, d):
    return tb.load(spark, d)


@query("order_documents", """
    SELECT o.order_id, coalesce(s.n_items, 0) AS n_items, coalesce(s.lines, '') AS lines
    FROM v_orders o LEFT JOIN (
      SELECT order_id, count(*) AS n_items,
             string_agg(CAST(product_id AS VARCHAR) || ':' || CAST(quantity AS VARCHAR), ','
                        ORDER BY product_id, quantity, unit_price, subtotal) AS lines
      FROM v_order_items GROUP BY order_id) s ON s.order_id = o.order_id""")
def q_order_documents(spark, d):
    t = _t(spark, d)
    doc = od.order_documents(t.orders, t.order_items)
    return doc.select("order_id", F.size("items").cast("bigint").alias("n_items"),
                      F.array_join(F.transform("items", lambda x: F.concat_ws(
                          ":", x["product_id"].cast("string"), x["quantity"].cast("string"))), ",").alias("lines"))


@query("order_totals", f"""
    SELECT o.order_id, CAST(s.sub AS DOUBLE) AS subtotal,
           CASE WHEN lower(o.delivery_type) <> 'delivery' THEN 0.0 WHEN s.sub >= st.threshold THEN 0.0
                ELSE st.fee END AS delivery_fee,
           CAST(s.sub AS DOUBLE) + CASE WHEN lower(o.delivery_type) <> 'delivery' THEN 0.0
                WHEN s.sub >= st.threshold THEN 0.0 ELSE st.fee END AS total_amount
    FROM v_orders o JOIN (SELECT order_id, sum(subtotal) AS sub FROM v_order_items GROUP BY 1) s
      ON s.order_id = o.order_id, {SET_ROW} st""", ctes=S_CTE)
def q_order_totals(spark, d):
    t = _t(spark, d)
    return od.order_totals(t.order_items, t.orders, settings_frame(spark))


@query("order_total_audit", f"""
    SELECT order_id, header_total, computed_total,
           round(CAST(header_total - computed_total AS DECIMAL(38,6)), 2)::DOUBLE AS difference,
           abs(header_total - computed_total) <= 0.005 AS matches
    FROM (SELECT o.order_id, o.total_amount AS header_total,
                 coalesce(CAST(s.sub AS DOUBLE) + CASE WHEN lower(o.delivery_type) <> 'delivery' THEN 0.0
                     WHEN s.sub >= st.threshold THEN 0.0 ELSE st.fee END, 0.0) AS computed_total
          FROM v_orders o LEFT JOIN (SELECT order_id, sum(subtotal) AS sub FROM v_order_items GROUP BY 1) s
            ON s.order_id = o.order_id, {SET_ROW} st)""", ctes=S_CTE)
def q_order_total_audit(spark, d):
    t = _t(spark, d)
    return od.order_total_audit(t.order_items, t.orders, settings_frame(spark))


@query("stock_shortfalls", """
    SELECT i.order_id, i.line_number, i.product_id, i.quantity AS requested, p.name AS product_name,
           p.stock_quantity AS available, coalesce(p.stock_quantity >= i.quantity, false) AS in_stock,
           greatest(0, i.quantity - p.stock_quantity) AS shortfall
    FROM v_order_items i LEFT JOIN v_products p ON p.id = i.product_id""")
def q_stock_shortfalls(spark, d):
    t = _t(spark, d)
    req = t.order_items.select("order_id", "line_number", "product_id", "quantity")
    return od.stock_check(req, t.products).select(
        "order_id", "line_number", "product_id", "requested", "product_name", "available", "in_stock",
        F.col("shortfall").cast("bigint").alias("shortfall"))


@query("products_filter", """
    SELECT * FROM v_products WHERE lower(category) = 'economy' AND stock_quantity <= 10
    ORDER BY id DESC LIMIT 50""")
def q_products_filter(spark, d):
    return od.products_filter(_t(spark, d).products, " Economy ", True, 50)


@query("in_stock_default", "SELECT * FROM v_products WHERE stock_quantity > 0 ORDER BY id LIMIT 10")
def q_in_stock_default(spark, d):
    return od.in_stock_default(_t(spark, d).products, 10)


@query("orders_by_status", """
    SELECT id, order_id, status, total_amount, created_at FROM v_orders WHERE status = 'CANCELLED'
    ORDER BY id DESC LIMIT 50""")
def q_orders_by_status(spark, d):
    return od.orders_by_status(_t(spark, d).orders, " cancelled ", 50).select(
        "id", "order_id", "status", "total_amount", "created_at")


@query("order_lookup", f"""
    SELECT r.event_id, r.requested_id, upper({X.strip('r.requested_id')}) AS order_id, o.status, o.total_amount,
           o.order_id IS NOT NULL AS found
    FROM (SELECT event_id, ' ord-' || CAST(event_id AS VARCHAR) || ' ' AS requested_id
          FROM events WHERE event_type = 'purchase') r
    LEFT JOIN v_orders o ON o.order_id = upper({X.strip('r.requested_id')})""")
def q_order_lookup(spark, d):
    t = _t(spark, d)
    ids = (t.raw("events").filter(F.col("event_type") == "purchase")
           .select("event_id", F.concat(F.lit(" ord-"), F.col("event_id").cast("string"), F.lit(" "))
                   .alias("requested_id")))
    return od.order_lookup(ids, t.orders).select("event_id", "requested_id", "order_id", "status",
                                                 "total_amount", "found")


@query("quarantine_rows", """
    SELECT o.id, concat_ws('; ',
             CASE WHEN s.order_id IS NULL THEN 'no items' END,
             CASE WHEN o.delivery_type = 'delivery' AND coalesce(o.delivery_address, '') = ''
                  THEN 'delivery without address' END,
             CASE WHEN o.total_amount < 0 THEN 'negative total' END,
             CASE WHEN coalesce(o.customer_phone, '') = '' THEN 'no phone' END) AS reasons
    FROM v_orders o LEFT JOIN (SELECT DISTINCT order_id FROM v_order_items) s ON s.order_id = o.order_id""")
def q_quarantine(spark, d):
    t = _t(spark, d)
    has = t.order_items.select("order_id").distinct().withColumn("_has", F.lit(True))
    o = t.orders.join(has, "order_id", "left")
    rules = [("no items", F.col("_has").isNull()),
             ("delivery without address", (F.col("delivery_type") == "delivery")
              & (F.coalesce("delivery_address", F.lit("")) == "")),
             ("negative total", F.col("total_amount") < 0),
             ("no phone", F.coalesce("customer_phone", F.lit("")) == "")]
    return od.quarantine(o, rules).select("id", "reasons")


@query("duplicate_names", """
    SELECT lower(name) AS name_key, count(*) AS n_products, min(id) AS first_id
    FROM v_products GROUP BY 1 HAVING count(*) > 1""")
def q_duplicate_names(spark, d):
    return od.duplicate_names(_t(spark, d).products)


@query("orphan_audit", """
    SELECT 'item_without_order' AS check_name, count(*) AS violations FROM v_order_items i
      WHERE NOT EXISTS (SELECT 1 FROM v_orders o WHERE o.order_id = i.order_id)
    UNION ALL SELECT 'item_without_product', count(*) FROM v_order_items i
      WHERE NOT EXISTS (SELECT 1 FROM v_products p WHERE p.id = i.product_id)
    UNION ALL SELECT 'customer_phone_null', count(*) FROM v_customers WHERE phone_number IS NULL
    UNION ALL SELECT 'order_phone_null', count(*) FROM v_orders WHERE customer_phone IS NULL
    UNION ALL SELECT 'customer_phone_duplicate', coalesce(sum(n), 0)::BIGINT FROM
      (SELECT count(*) n FROM v_customers GROUP BY phone_number HAVING count(*) > 1)
    UNION ALL SELECT 'product_name_duplicate', coalesce(sum(n), 0)::BIGINT FROM
      (SELECT count(*) n FROM v_products GROUP BY name HAVING count(*) > 1)
    UNION ALL SELECT 'order_id_duplicate', coalesce(sum(n), 0)::BIGINT FROM
      (SELECT count(*) n FROM v_orders GROUP BY order_id HAVING count(*) > 1)""")
def q_orphan_audit(spark, d):
    t = _t(spark, d)
    return od.constraint_audit(t.customers, t.products, t.orders, t.order_items)


@query("settings_enriched_orders", f"""
    SELECT o.order_id,
           CASE WHEN lower(o.delivery_type) <> 'delivery' THEN 0.0 WHEN o.total_amount >= st.threshold THEN 0.0
                ELSE st.fee END AS delivery_fee,
           CAST(st.eta - 5 AS VARCHAR) || ' to ' || CAST(st.eta + 5 AS VARCHAR) || ' minutes (approx '
             || strftime(o.created_at + to_minutes(st.eta), '%-I:%M %p') || ')' AS eta
    FROM v_orders o, {SET_ROW} st""", ctes=S_CTE)
def q_settings_enriched(spark, d):
    t = _t(spark, d)
    return od.settings_enriched_orders(t.orders, settings_frame(spark))
