"""Registered query: tool calls run as one batch in their order.

The calls are made from the turns of ``conversations``.  The oracle resolves item names
with the SQL of J4 and then goes through the calls one by one in a recursive query over
maps: phones, names, addresses, stock and order statuses."""

from __future__ import annotations

from pyspark.sql import functions as F

from kirana.functions.lexicon import TEST_SYNONYMS, synonyms_frame
from kirana.operators import tools as tl
from kirana.plans import sql_exprs as X
from kirana.plans.base import query
from kirana.plans.q_search import RESOLVE_SQL, SYN_SQL, search_sql
from kirana.plans.q_sinks import SET_VALUES
from kirana.sources import tables as tb
from kirana.sources.settings import settings_frame

# One call a turn.  Twelve products are asked for again and again, so that stock runs out
# and comes back; orders are tracked and cancelled after and before they are placed.
CALLS_SQL = """
  SELECT call_id, seq, caller_phone,
         CASE kind WHEN 0 THEN 'place_order' WHEN 1 THEN 'place_order' WHEN 2 THEN 'register_caller' WHEN 3 THEN 'register_caller' WHEN 4 THEN 'check_stock'
                   WHEN 5 THEN 'cancel_existing_order' WHEN 6 THEN 'cancel_existing_order' WHEN 7 THEN 'track_order' WHEN 8 THEN 'search_catalog'
                   WHEN 9 THEN 'open_till' ELSE 'place_order' END AS tool,
         CASE kind WHEN 0 THEN '{"customer_name": "Ann ' || conv_id || '", "items": [{"name": "' || upper(one) || '", "quantity": ' || (h % 30 + 1) || '}]}'
                   WHEN 1 THEN '{"delivery_type": "' || CASE h % 3 WHEN 0 THEN 'Pickup' ELSE 'delivery' END || '", "items": [{"name": "' || one || ' 1kg", "quantity": "3"}, "' || two || '"]}'
                   WHEN 2 THEN '{"customer_phone": "' || own || '", "customer_name": " N' || h || '", "delivery_address": "A' || turn || ' "}'
                   WHEN 3 THEN '{"customer_name": "M' || h || '", "delivery_address": "' || CASE h % 5 WHEN 0 THEN '' ELSE 'B' || turn END || '"}'
                   WHEN 4 THEN '{"product_name": "' || CASE h % 4 WHEN 0 THEN 'no such thing' ELSE two END || '", "quantity": ' || (h % 60) || '}'
                   WHEN 5 THEN '{"order_id": " ord-' || (h % 400) || ' "}' WHEN 6 THEN '{"order_id": "ORD-C' || (call_id - 1 - h % 3) || '"}'
                   WHEN 7 THEN '{"order_id": "ord-' || CASE h % 2 WHEN 0 THEN '' || (h % 300) ELSE 'c' || (call_id - 2) END || '"}'
                   WHEN 8 THEN '{"query": "' || two || '"}' WHEN 9 THEN '{"x": 1}' WHEN 10 THEN 'items: ' || one
                   ELSE '{"customer_phone": "", "items": "[{\\"name\\": \\"' || one || '\\"}, {\\"name\\": \\"zzqx\\"}]"}' END AS arguments
  FROM (SELECT c.*, p.p_name AS one, q.p_name AS two, h // 2 % 12 AS kind
        FROM (SELECT conv_id, turn, conv_id * 100 + turn AS call_id, turn * 1000000 + conv_id AS seq, conv_id * 31 + turn * 17 AS h,
                     CASE WHEN conv_id % 6 = 5 THEN NULL ELSE '0' || CAST(9000000000 + conv_id % 40 + 1 AS VARCHAR) END AS caller_phone,
                     CAST(9000000000 + (conv_id * 7) % 90 AS VARCHAR) AS own FROM conversations) c
        JOIN part p ON p.p_partkey = c.h % 12 + 1 JOIN part q ON q.p_partkey = (c.h // 3) % 12 + 1)"""


def tool_calls(spark, d):
    c = tb.read_table(spark, d, "conversations")
    part = tb.read_table(spark, d, "part").select("p_partkey", "p_name")
    conv, turn = F.col("conv_id"), F.col("turn")
    c = c.select("conv_id", "turn", (conv * 100 + turn).alias("call_id"), (turn * 1000000 + conv).alias("seq"), (conv * 31 + turn * 17).alias("h"),
                 F.when(conv % 6 != 5, F.concat(F.lit("0"), (F.lit(9000000000) + conv % 40 + 1).cast("string"))).alias("caller_phone"),
                 (F.lit(9000000000) + (conv * 7) % 90).cast("string").alias("own"))
    c = (c.join(part.select((F.col("p_partkey") - 1).alias("_p"), F.col("p_name").alias("one")), F.col("h") % 12 == F.col("_p"))
         .join(part.select((F.col("p_partkey") - 1).alias("_q"), F.col("p_name").alias("two")), F.floor(F.col("h") / 3) % 12 == F.col("_q")))
    h = F.col("h")

    def s(x):
        return x.cast("string")

    def text(*xs):
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])

    args = [
        text('{"customer_name": "Ann ', s(conv), '", "items": [{"name": "', F.upper("one"), '", "quantity": ', s(h % 30 + 1), "}]}"),
        text('{"delivery_type": "', F.when(h % 3 == 0, "Pickup").otherwise("delivery"), '", "items": [{"name": "', F.col("one"), ' 1kg", "quantity": "3"}, "', F.col("two"), '"]}'),
        text('{"customer_phone": "', F.col("own"), '", "customer_name": " N', s(h), '", "delivery_address": "A', s(turn), ' "}'),
        text('{"customer_name": "M', s(h), '", "delivery_address": "', F.when(h % 5 == 0, "").otherwise(text("B", s(turn))), '"}'),
        text('{"product_name": "', F.when(h % 4 == 0, "no such thing").otherwise(F.col("two")), '", "quantity": ', s(h % 60), "}"),
        text('{"order_id": " ord-', s(h % 400), ' "}'),
        text('{"order_id": "ORD-C', s(F.col("call_id") - 1 - h % 3), '"}'),
        text('{"order_id": "ord-', F.when(h % 2 == 0, s(h % 300)).otherwise(text("c", s(F.col("call_id") - 2))), '"}'),
        text('{"query": "', F.col("two"), '"}'), F.lit('{"x": 1}'), text("items: ", F.col("one")),
        text('{"customer_phone": "", "items": "[{\\"name\\": \\"', F.col("one"), '\\"}, {\\"name\\": \\"zzqx\\"}]"}')]
    tools = ["place_order"] * 2 + ["register_caller"] * 2 + ["check_stock"] + ["cancel_existing_order"] * 2 + ["track_order", "search_catalog", "open_till"] + ["place_order"] * 2
    kind = (F.floor(h / 2) % 12).cast("int")
    return c.select("call_id", "seq", "caller_phone", F.element_at(F.array(*map(F.lit, tools)), kind + 1).alias("tool"), F.element_at(F.array(*args), kind + 1).alias("arguments"))


_ARG = "json_extract_string(CASE WHEN json_valid(arguments) AND json_type(arguments) = 'OBJECT' THEN arguments ELSE '{{}}' END, '$.{0}')"
ARGS_SQL = f"""
  SELECT call_id, seq, tool, {X.strip(f"coalesce(nullif({_ARG.format('customer_phone')}, ''), caller_phone, '')")} AS raw,
         {X.strip(f"coalesce({_ARG.format('customer_name')}, '')")} AS name, {X.strip(f"coalesce({_ARG.format('delivery_address')}, '')")} AS address,
         lower(coalesce({_ARG.format('delivery_type')}, 'delivery')) AS delivery_type, coalesce({_ARG.format('items')}, '[]') AS items,
         coalesce({_ARG.format('product_name')}, '') AS product_name, coalesce({_ARG.format('quantity')}, '1') AS quantity, coalesce({_ARG.format('query')}, '') AS query,
         CASE WHEN tool = 'place_order' THEN 'ORD-C' || call_id ELSE upper({X.strip(f"coalesce({_ARG.format('order_id')}, '')")}) END AS order_id
  FROM v_tool_calls"""
LINES_SQL = """
  SELECT call_id, pos, CAST(json_extract(items, '$[*]') AS JSON[])[pos + 1] AS o, NULL AS q FROM (SELECT call_id, items, unnest(range(json_array_length(items)::BIGINT)) AS pos FROM v_tool_args WHERE tool = 'place_order')
  UNION ALL SELECT call_id, 0, to_json(product_name), quantity FROM v_tool_args WHERE tool = 'check_stock'"""
LINE_SQL = """
  SELECT call_id, pos, CASE WHEN json_type(o) = 'OBJECT' THEN coalesce(json_extract_string(o, '$.name'), '') ELSE json_extract_string(o, '$') END AS name,
         CASE WHEN n <= 0 THEN 1 ELSE n END AS quantity
  FROM (SELECT *, coalesce(try_cast(coalesce(q, json_extract_string(CASE WHEN json_type(o) = 'OBJECT' THEN o END, '$.quantity'), '1') AS BIGINT), 1) AS n FROM v_tool_lines0)"""
STEPS_SQL = f"""
  WITH RECURSIVE per AS (
    SELECT l.call_id, list({{'pos': l.pos, 'product': r.matched_id, 'n': l.quantity}} ORDER BY l.pos) AS lines,
           sum(CAST(p.price AS DECIMAL(18,2)) * l.quantity)::DOUBLE AS subtotal
    FROM v_tool_line l LEFT JOIN v_tool_resolution r ON r.line_id = l.name || '|' LEFT JOIN v_products p ON p.id = r.matched_id GROUP BY 1),
  base AS (SELECT order_id, list({{'product': product_id, 'n': quantity}}) AS units FROM v_order_items WHERE order_id IN (SELECT order_id FROM v_tool_args) GROUP BY 1),
  raw AS (SELECT a.*, {X.norm_phone('raw')} AS norm, per.lines, per.subtotal, row_number() OVER (ORDER BY seq) AS k,
                 (SELECT max(id) FROM v_customers) + 2 * count(*) FILTER (tool = 'register_caller') OVER (ORDER BY seq) - 1 AS fresh,
                 coalesce(base.units, list_transform(src.lines, lambda l: {{'product': l.product, 'n': l.n}})) AS units
          FROM v_tool_args a LEFT JOIN per USING (call_id) LEFT JOIN base USING (order_id)
          LEFT JOIN per src ON src.call_id = try_cast(substr(a.order_id, 6) AS BIGINT) AND a.order_id LIKE 'ORD-C%'),
  ch AS (SELECT *, CASE WHEN length(norm) = 10 THEN '+91' || norm ELSE raw END AS canon,
                CASE WHEN norm <> '' AND (length(norm) = 10 OR norm <> raw) THEN norm END AS alias FROM raw),
  st(k, phones, names, homes, stock, status, reason, who, before, left_) AS (
    SELECT 0::BIGINT, (SELECT map_from_entries(list((phone_number, id))) FROM v_customers), (SELECT map_from_entries(list((id, name))) FROM v_customers),
           (SELECT map_from_entries(list((id, address))) FROM v_customers), (SELECT map_from_entries(list((id, stock_quantity))) FROM v_products),
           (SELECT map_from_entries(list((order_id, status))) FROM v_orders), 'ok', NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT
    UNION ALL
    SELECT k, CASE WHEN tool = 'register_caller' AND reason = 'ok' AND who = fresh THEN map_concat(phones, CASE WHEN alias IS NULL THEN map([canon], [fresh]) ELSE map([canon, alias], [fresh, fresh + 1]) END) ELSE phones END,
           CASE WHEN tool = 'register_caller' AND reason = 'ok' THEN map_concat(names, CASE WHEN who = fresh THEN map([fresh, fresh + 1], [name, name]) ELSE map([who], [name]) END) ELSE names END,
           CASE WHEN tool = 'register_caller' AND reason = 'ok' THEN map_concat(homes, CASE WHEN who = fresh THEN map([fresh, fresh + 1], [address, address]) ELSE map([who], [address]) END) ELSE homes END,
           CASE WHEN reason = 'accepted' THEN map_concat(stock, map_from_entries(list_transform(list_distinct(list_transform(lines, lambda l: l.product)),
                  lambda p: (p, map_extract(stock, p)[1] - list_sum(list_transform(list_filter(lines, lambda l: l.product = p), lambda l: l.n))::BIGINT))))
                WHEN reason = 'cancelled' THEN map_concat(stock, map_from_entries(list_transform(list_distinct(list_transform(units, lambda l: l.product)),
                  lambda p: (p, map_extract(stock, p)[1] + list_sum(list_transform(list_filter(units, lambda l: l.product = p), lambda l: l.n))::BIGINT)))) ELSE stock END,
           CASE WHEN reason = 'accepted' THEN map_concat(status, map([order_id], ['CONFIRMED'])) WHEN reason = 'cancelled' THEN map_concat(status, map([order_id], ['CANCELLED'])) ELSE status END,
           reason, who, before, left_
    FROM (SELECT *, CASE WHEN tool = 'register_caller' THEN CASE WHEN name = '' THEN 'empty name' WHEN address = '' THEN 'empty address' WHEN raw = '' THEN 'empty phone' ELSE 'ok' END
                         WHEN tool = 'search_catalog' THEN 'ok'
                         WHEN tool = 'track_order' THEN CASE WHEN before IS NULL THEN 'not found' ELSE 'found' END
                         WHEN tool = 'cancel_existing_order' THEN CASE WHEN before IS NULL THEN 'not found' WHEN before = 'CANCELLED' THEN 'already cancelled' ELSE 'cancelled' END
                         WHEN tool = 'place_order' THEN CASE WHEN lines IS NULL THEN 'no items' ELSE coalesce(fault, 'accepted') END
                         WHEN tool = 'check_stock' THEN coalesce(fault, 'in stock') ELSE 'Unknown tool name: ' || tool END AS reason
          FROM (SELECT *, list_filter(list_transform(lines, lambda l: CASE WHEN l.product IS NULL THEN 'not found' WHEN map_extract(stock, l.product)[1] < l.n THEN 'insufficient stock' END), lambda f: f IS NOT NULL)[1] AS fault,
                       map_extract(stock, lines[1].product)[1] AS left_, CASE WHEN tool = 'register_caller' THEN coalesce(found, fresh) ELSE found END AS who
                FROM (SELECT c.*, s.phones, s.names, s.homes, s.stock, s.status, map_extract(s.status, c.order_id)[1] AS before,
                             CASE WHEN raw <> '' THEN coalesce(map_extract(s.phones, raw)[1], map_extract(s.phones, norm)[1], map_extract(s.phones, CASE WHEN norm <> '' THEN '+91' || norm ELSE raw END)[1],
                               map_extract(s.phones, CASE WHEN norm <> '' THEN '0' || norm ELSE raw END)[1]) END AS found
                      FROM st s JOIN ch c ON c.k = s.k + 1))))
  SELECT ch.*, st.reason, st.who, st.before, st.left_, map_extract(st.names, st.who)[1] AS their_name, map_extract(st.homes, st.who)[1] AS their_home FROM ch JOIN st ON st.k = ch.k"""
SEARCH_SQL = "WITH " + search_sql("v_tool_queries") + "\nSELECT qid, list(id ORDER BY rank) AS products FROM search_result GROUP BY qid"
FEES_SQL = f"""SELECT max(CASE WHEN key = 'delivery_fee' THEN CAST(value AS DOUBLE) END) AS fee, max(CASE WHEN key = 'free_delivery_threshold' THEN CAST(value AS DOUBLE) END) AS threshold
               FROM (VALUES {SET_VALUES}) t(key, value, description)"""
TOOL_CTES = {
    "v_tool_calls": CALLS_SQL, "v_tool_args": ARGS_SQL, "v_tool_lines0": LINES_SQL, "v_tool_line": LINE_SQL, "v_synonyms": SYN_SQL,
    "v_requests": "SELECT DISTINCT name, CAST(NULL AS BIGINT) AS product_id FROM v_tool_line",
    "v_rq": "SELECT DISTINCT regexp_replace(name, '^\\s+|\\s+$', '', 'g') AS qid, regexp_replace(name, '^\\s+|\\s+$', '', 'g') AS query FROM v_requests",
    "v_tool_resolution": RESOLVE_SQL, "v_tool_steps": STEPS_SQL, "v_tool_queries": "SELECT call_id AS qid, query FROM v_tool_args WHERE tool = 'search_catalog'",
    "v_tool_hits": SEARCH_SQL, "v_tool_fees": FEES_SQL}


@query("tool_batch", """
    SELECT call_id, tool, reason IN ('ok', 'accepted', 'in stock', 'found', 'cancelled') AS ok, reason,
           CASE WHEN (tool = 'register_caller' AND reason = 'ok') OR reason = 'accepted' THEN who END AS customer_id,
           CASE WHEN reason = 'accepted' THEN coalesce(nullif(name, ''), their_name, 'Valued Customer') WHEN tool = 'register_caller' AND reason = 'ok' THEN name END AS customer_name,
           CASE WHEN reason = 'accepted' THEN coalesce(nullif(address, ''), CASE WHEN delivery_type = 'delivery' THEN their_home END, 'Store Pickup')
                WHEN tool = 'register_caller' AND reason = 'ok' THEN address END AS address,
           CASE WHEN reason = 'accepted' OR tool IN ('track_order', 'cancel_existing_order') THEN order_id END AS order_id,
           CASE WHEN reason = 'accepted' THEN 'CONFIRMED' WHEN tool = 'track_order' THEN before WHEN reason = 'cancelled' THEN 'CANCELLED' END AS status,
           CASE WHEN reason = 'accepted' THEN round(subtotal + CASE WHEN delivery_type <> 'delivery' OR subtotal >= threshold THEN 0 ELSE fee END, 2) END AS total_amount,
           CASE WHEN tool = 'check_stock' THEN lines[1].product END AS product_id, CASE WHEN tool = 'check_stock' THEN left_ END AS available,
           CASE WHEN tool = 'search_catalog' THEN coalesce(h.products, []) END AS products
    FROM v_tool_steps s LEFT JOIN v_tool_hits h ON h.qid = s.call_id, v_tool_fees""", ctes=TOOL_CTES)
def q_tool_batch(spark, d):
    t = tb.load(spark, d)
    out = tl.tool_batch(tool_calls(spark, d), t.customers, t.products, t.orders, t.order_items, settings_frame(spark), synonyms_frame(spark, TEST_SYNONYMS), ["seq"])
    return out.drop("result")
