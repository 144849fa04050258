"""The single-expression rules as SQL functions.

``CREATE TEMPORARY FUNCTION ... RETURN <expr>`` defines SQL scalar and
table functions that the optimizer inlines into the calling plan (no
Python at run time), so SQL users get the same rules as the DataFrame API.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from kirana.functions.text import GREETINGS
from kirana.sources.search_index import register

SCALAR = {
    "kirana_normalize_phone": ("p STRING", "STRING",
                               r"regexp_replace(regexp_replace(regexp_replace(coalesce(p, ''), '[^\\p{Nd}]', ''), "
                               r"'^91(\\p{Nd}{10})$', '$1'), '^0(\\p{Nd}{10})$', '$1')"),
    "kirana_is_repetitive": ("t STRING", "BOOLEAN",
                             r"length(regexp_replace(coalesce(t, ''), '^\\s+|\\s+$', '')) < 2 OR "
                             r"regexp_replace(coalesce(t, ''), '^\\s+|\\s+$', '') RLIKE '(.)\\1{4,}'"),
    "kirana_greeting_intent": ("t STRING", "BOOLEAN",
                               r"translate(lower(regexp_replace(t, '^\\s+|\\s+$', '')), '?!.', '') IN "
                               + "(" + ", ".join(f"'{g}'" for g in GREETINGS) + ")"),
    "kirana_order_ref": ("k STRING", "STRING", "concat('ORD-', upper(substr(sha2(k, 256), 1, 12)))"),
    "kirana_has_kannada": ("t STRING", "BOOLEAN", r"t RLIKE '[\\u0C80-\\u0CFF]'"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Register the scalar SQL functions in the session; returns their names."""
    for name, (args, ret, body) in SCALAR.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
    return list(SCALAR)


def register_table_functions(spark: SparkSession, orders_view: str = "v_orders", search_index: str | None = None, synonyms_view: str = "v_synonyms") -> list[str]:
    """SQL table functions.  ``kirana_order_history(phone)`` over a registered orders view
    (matches stored, normalised and +91 forms), and, with the path of a stored index
    (``search_index.build``), ``kirana_search_catalog(q)``."""
    register_functions(spark)
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION kirana_order_history(phone STRING)
        RETURNS TABLE (order_id STRING, customer_phone STRING, total_amount DOUBLE, status STRING)
        RETURN SELECT order_id, customer_phone, total_amount, status FROM {orders_view}
               WHERE customer_phone IN (phone, kirana_normalize_phone(phone),
                                        concat('+91', kirana_normalize_phone(phone)))""")
    if search_index is None:
        return ["kirana_order_history"]
    register(spark, search_index, synonyms_view)
    return ["kirana_order_history", "kirana_search_catalog"]
