"""Caller -> customer resolution and customer-side reports (J1, J3, J8, J9, A6, FIL2).

The reference looks up one caller at a time with ``phone IN (candidates)
LIMIT 1``.  Here a whole table of calls is resolved in one plan: explode
each call's candidate phones, equi-join on the customer phone (a hash /
sort-merge join chosen by Catalyst; AQE splits a hot phone), then keep
the best hit per call with a ``min(struct)`` aggregate, which combines
map-side instead of sorting whole window partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kirana.functions.phone import normalize_phone, with_history_candidates, with_phone_candidates
from kirana.operators.orders import nested_lines


def _candidate_hits(calls: DataFrame, customers: DataFrame, key: str, phone_col: str) -> DataFrame:
    cand = (with_phone_candidates(calls.select(F.col(key).alias("_k"), F.col(phone_col).alias("_p")), "_p", "_c")
            .select("_k", F.posexplode("_c").alias("_pos", "_phone")))
    cust = customers.select(F.col("id").alias("_cid"), F.col("phone_number").alias("_phone"))
    return cand.join(cust, "_phone")


def resolve_customers(calls: DataFrame, customers: DataFrame, key: str = "id",
                      phone_col: str = "customer_phone") -> DataFrame:
    """One row per call with the matched customer (NULLs when none).

    Tie-break pinned to (candidate position, customer id); the reference
    has ``LIMIT 1`` without ORDER BY.
    """
    best = (_candidate_hits(calls, customers, key, phone_col)
            .groupBy("_k")
            .agg(F.min(F.struct("_pos", "_cid", "_phone")).alias("_b"))
            .select("_k", F.col("_b._cid").alias("customer_id"),
                    F.col("_b._phone").alias("matched_phone")))
    cust = customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"),
                            F.col("address").alias("customer_address"))
    return (calls.join(best, calls[key] == best["_k"], "left").drop("_k")
            .join(cust, "customer_id", "left"))


def registered_callers(calls: DataFrame, customers: DataFrame, key: str = "id",
                       phone_col: str = "customer_phone") -> DataFrame:
    """Calls with at least one customer match (left semi join)."""
    hits = _candidate_hits(calls, customers, key, phone_col).select(F.col("_k").alias(key))
    return calls.join(hits, key, "left_semi")


def unregistered_callers(calls: DataFrame, customers: DataFrame, key: str = "id",
                         phone_col: str = "customer_phone") -> DataFrame:
    """Calls with no customer match (left anti join)."""
    hits = _candidate_hits(calls, customers, key, phone_col).select(F.col("_k").alias(key))
    return calls.join(hits, key, "left_anti")


def order_item_summary(items: DataFrame) -> DataFrame:
    """Per-order lines, their count and exact money total (aggregated before any join)."""
    return items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum("quantity").alias("n_units"),
        F.sum(F.col("subtotal").cast("decimal(18,2)")).alias("items_total"),
        nested_lines().alias("items"))


def customer_order_history(customers: DataFrame, orders: DataFrame, items: DataFrame,
                           newest_first: bool = True) -> DataFrame:
    """Every customer's orders, with their lines, across phone formats
    [stored, norm, +91norm]; newest first per customer (time, then order key).

    Equi-join of exploded candidates against ``orders.customer_phone``;
    the per-order lines are aggregated before they are joined.  Customers are
    brought together by a rebalancing shuffle, whose large partitions Spark splits,
    and sorted within partitions: a customer's rows follow one another newest first,
    unless there are so many that they are split, where each part is in order.
    ``newest_first=False`` leaves it out where the rows are only joined on.
    """
    cand = (with_history_candidates(customers.select(F.col("id").alias("customer_id"), "phone_number"),
                                    "phone_number", "_c")
            .select("customer_id", F.explode("_c").alias("customer_phone")))
    o = orders.select(F.col("id").alias("order_key"), "order_id", "customer_phone", "total_amount",
                      "status", "created_at")
    hist = cand.join(o, "customer_phone")
    per_order = order_item_summary(items)
    out = (hist.join(per_order, "order_id", "left")
           .select("customer_id", "order_key", "order_id", "customer_phone", "total_amount", "status",
                   "created_at", F.coalesce("n_items", F.lit(0)).alias("n_items"),
                   F.coalesce("items_total", F.lit(0).cast("decimal(28,2)")).alias("items_total"),
                   F.coalesce("items", F.array().cast(per_order.schema["items"].dataType)).alias("items")))
    if not newest_first:
        return out
    return out.hint("rebalance", "customer_id").sortWithinPartitions("customer_id", F.desc("created_at"), F.desc("order_key"))


def distinct_customers(customers: DataFrame) -> DataFrame:
    """Row count (what the reference reports) and distinct people by normalised phone."""
    return customers.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(normalize_phone(F.col("phone_number"))).alias("n_people"))


def distinct_customers_approx(customers: DataFrame, rsd: float = 0.02) -> DataFrame:
    """A6 (approximate form): HyperLogLog++ sketch, mergeable across partitions."""
    return customers.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.approx_count_distinct(normalize_phone(F.col("phone_number")), rsd).alias("n_people_approx"))


def people_sketches(customers: DataFrame, day: str, log_k: int = 14) -> DataFrame:
    """A6 (stored form): one mergeable sketch of the distinct people a day, with the rows counted;
    ``people_total`` adds days up without reading the customers again."""
    return customers.groupBy(day).agg(F.count(F.lit(1)).alias("n_rows"), F.hll_sketch_agg(normalize_phone(F.col("phone_number")), log_k).alias("people"))


def people_total(sketches: DataFrame) -> DataFrame:
    """Rows and about how many distinct people over the days of ``people_sketches``."""
    return sketches.agg(F.sum("n_rows").alias("n_rows"), F.hll_sketch_estimate(F.hll_union_agg("people")).alias("n_people_approx"))


def customer_search(customers: DataFrame, q: str) -> DataFrame:
    """FIL2: case-insensitive literal substring on name OR phone OR address, id desc."""
    needle = F.lit(q.strip().lower())
    hit = (F.lower("name").contains(needle) | F.lower("phone_number").contains(needle)
           | F.lower("address").contains(needle))
    return customers.filter(hit).orderBy(F.desc("id"))
