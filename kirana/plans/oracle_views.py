"""The store-model binding views written as DuckDB SQL.

These are the oracle's own definitions of FIXTURES.md §2, written
independently of the DataFrame builders in ``kirana.sources.tables``.
``with_views(sql)`` prepends the CTEs a query refers to.
"""

from __future__ import annotations

import re


def _fmt(fmt_expr: str, key: str) -> str:
    b = f"CAST(9000000000 + {key} AS VARCHAR)"
    return (f"CASE {fmt_expr} WHEN 0 THEN '+91' || {b} WHEN 1 THEN {b} "
            f"WHEN 2 THEN '0' || {b} "
            f"ELSE '+91 ' || substr({b}, 1, 5) || '-' || substr({b}, 6, 5) END")


VIEWS: dict[str, str] = {
    "v_customers": f"""
        SELECT c_custkey AS id, {_fmt('c_custkey % 4', 'c_custkey')} AS phone_number,
               c_name AS name, c_mktsegment AS address
        FROM customer""",
    "v_products": """
        SELECT p_partkey AS id, p_name AS name, p_type AS category, p_retailprice AS price,
               p_brand AS unit, CAST(p_size AS BIGINT) AS stock_quantity
        FROM part""",
    "v_orders": f"""
        SELECT o_orderkey AS id, 'ORD-' || CAST(o_orderkey AS VARCHAR) AS order_id,
               CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Caller ' || CAST(o_custkey AS VARCHAR) END
                 AS customer_name,
               {_fmt('(o_orderkey + o_custkey) % 4', 'o_custkey')} AS customer_phone,
               CASE WHEN o_orderkey % 5 = 0 THEN 'pickup' ELSE 'delivery' END AS delivery_type,
               CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE 'Addr ' || CAST(o_custkey AS VARCHAR) END
                 AS delivery_address,
               o_totalprice AS total_amount,
               CASE o_orderstatus WHEN 'O' THEN 'CONFIRMED' WHEN 'F' THEN 'DELIVERED'
                    WHEN 'P' THEN 'CANCELLED' END AS status,
               o_orderdate AS created_at
        FROM orders""",
    "v_order_items": """
        SELECT 'ORD-' || CAST(l_orderkey AS VARCHAR) AS order_id, l_orderkey AS order_key,
               l_linenumber AS line_number, l_partkey AS product_id,
               CAST(l_quantity AS BIGINT) AS quantity, l_extendedprice / l_quantity AS unit_price,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS subtotal, l_shipdate AS shipped_at,
               l_returnflag AS return_flag
        FROM lineitem""",
    "v_frames": """
        SELECT user_id AS call, event_id, ts, value AS energy, value >= 50 AS loud
        FROM events""",
    "v_call_events": """
        SELECT 'CALL-' || CAST(user_id AS VARCHAR) AS call_sid, user_id AS call, event_id, ts,
               CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'end'
                    WHEN 'error' THEN 'interrupt' WHEN 'click' THEN 'loud'
                    WHEN 'view' THEN 'bot_audio' END AS kind,
               value,
               CASE WHEN event_type = 'purchase' THEN value END AS duration,
               CASE WHEN event_type = 'purchase' AND event_id % 2 = 0
                    THEN 'ORD-' || CAST(event_id AS VARCHAR) END AS order_id
        FROM events""",
    "v_stock_moves": """
        SELECT l_partkey AS product_id, l_shipdate AS ts,
               CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT)
                    ELSE -CAST(l_quantity AS BIGINT) END AS delta,
               l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_discount, l_tax,
               l_returnflag, l_linestatus
        FROM lineitem""",
    "v_turns": "SELECT conv_id, turn, role, text FROM conversations",
}

_ORDER = list(VIEWS)


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prepend the binding views (and any extra named CTEs) used by ``sql``."""
    defs = dict(VIEWS)
    if extra:
        defs.update(extra)
    used: list[str] = []

    def visit(text: str) -> None:
        for name in defs:
            if name not in used and re.search(rf"\b{name}\b", text):
                visit(defs[name])
                if name not in used:
                    used.append(name)

    visit(sql)
    if not used:
        return sql
    ctes = ",\n".join(f"{n} AS ({defs[n]})" for n in used)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
