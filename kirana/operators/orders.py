"""Orders, lines and catalog listings (A4, A5, A11, J2, J10, J11, J13, FIL1, FIL3,
FIL5-FIL7, X3).

Line-level work is aggregated per order *before* it meets the order
headers, so each join sees one row per order; the settings side is a
single typed row (bounded size), which is the only thing broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kirana.functions.phone import py_strip
from kirana.functions.text import delivery_fee, eta_window, safe_quantity
from kirana.sources.settings import settings_row


def nested_lines() -> Column:
    """Aggregate: the lines of one order as a sorted array of structs."""
    line = F.struct("product_id", "quantity", "unit_price", F.col("subtotal").cast("double").alias("subtotal"))
    return F.sort_array(F.collect_list(line))


def order_documents(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders with their lines nested as a sorted array (``[]`` when none)."""
    nested = items.groupBy("order_id").agg(nested_lines().alias("items"))
    return (orders.join(nested, "order_id", "left")
            .withColumn("items", F.coalesce("items", F.array().cast(nested.schema["items"].dataType))))


def with_settings(orders: DataFrame, settings: DataFrame) -> DataFrame:
    """Attach the scalar settings (one row, broadcast) to every order."""
    return orders.crossJoin(F.broadcast(settings_row(settings)))


def order_totals(items: DataFrame, orders: DataFrame, settings: DataFrame) -> DataFrame:
    """A4: subtotal = sum of line subtotals; fee by delivery type and threshold; total."""
    sub = items.groupBy("order_id").agg(F.sum(F.col("subtotal").cast("decimal(18,2)")).alias("_sub"))
    o = with_settings(orders.select("order_id", "delivery_type"), settings)
    j = o.join(sub, "order_id")
    fee = delivery_fee(F.col("delivery_type"), F.col("_sub"), F.col("fee"), F.col("threshold"))
    return j.select("order_id", F.col("_sub").cast("double").alias("subtotal"), fee.alias("delivery_fee"),
                    (F.col("_sub") + fee).cast("double").alias("total_amount"))


def order_total_audit(items: DataFrame, orders: DataFrame, settings: DataFrame,
                      tolerance: float = 0.005) -> DataFrame:
    """Recomputed total (lines + fee) against the stored header total."""
    t = order_totals(items, orders, settings).withColumnRenamed("total_amount", "computed_total")
    h = orders.select("order_id", F.col("total_amount").alias("header_total"))
    j = h.join(t, "order_id", "left").withColumn("computed_total", F.coalesce("computed_total", F.lit(0.0)))
    diff = F.round((F.col("header_total") - F.col("computed_total")).cast("decimal(38,6)"), 2).cast("double")
    return j.select("order_id", "header_total", "computed_total", diff.alias("difference"),
                    (F.abs(F.col("header_total") - F.col("computed_total")) <= tolerance).alias("matches"))


def stock_check(requests: DataFrame, products: DataFrame, qty_col: str = "quantity",
                floor_one: bool = False) -> DataFrame:
    """A5: requested vs available per request line (product resolved by id).

    ``floor_one=False`` is the stock-check mode (0 or negative requests pass),
    ``True`` the order mode (unparsable or non-positive -> 1)."""
    p = products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"),
                        F.col("stock_quantity").alias("available"))
    req = safe_quantity(F.col(qty_col), floor_one)
    j = requests.withColumn("requested", req).join(p, "product_id", "left")
    ok = F.col("available") >= F.col("requested")
    reason = (F.when(F.col("available").isNull(), F.lit("not found"))
              .when(~ok, F.format_string("Only %d units of '%s' available.", F.col("available"),
                                         F.col("product_name"))))
    return j.select(*requests.columns, "requested", "product_name", "available",
                    F.coalesce(ok, F.lit(False)).alias("in_stock"),
                    F.greatest(F.lit(0), F.col("requested") - F.col("available")).alias("shortfall"),
                    reason.alias("reason"))


def products_filter(products: DataFrame, category: str = "", low_stock: bool = False,
                    limit: int = 50) -> DataFrame:
    """FIL1: optional case-insensitive category, optional stock <= 10, newest first, top ``limit``.
    Out-of-stock rows are included.  ``orderBy + limit`` plans as a per-partition
    top-k (TakeOrderedAndProject), never a full sort."""
    df = products
    if category.strip():
        df = df.filter(F.lower("category") == category.strip().lower())
    if low_stock:
        df = df.filter(F.col("stock_quantity") <= 10)
    return df.orderBy(F.desc("id")).limit(limit)


def in_stock_default(products: DataFrame, n: int = 10) -> DataFrame:
    """FIL6: first ``n`` in-stock products (order pinned to id)."""
    return products.filter(F.col("stock_quantity") > 0).orderBy("id").limit(n)


def orders_by_status(orders: DataFrame, status: str, limit: int = 50) -> DataFrame:
    """FIL3: status filter (trim + upper), newest first, top ``limit``."""
    return orders.filter(F.col("status") == status.strip().upper()).orderBy(F.desc("id")).limit(limit)


def order_lookup(ids: DataFrame, orders: DataFrame, id_col: str = "requested_id") -> DataFrame:
    """FIL5: a batch of order ids normalised ``upper(trim)`` looked up with a found flag."""
    r = ids.withColumn("order_id", F.upper(py_strip(F.col(id_col))))
    o = orders.select("order_id", "status", "total_amount", F.lit(True).alias("_hit"))
    return (r.join(o, "order_id", "left")
            .withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit"))


def quarantine(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """FIL7: attach the reasons (in rule order) a row fails; ``ok`` when none."""
    reasons = F.concat_ws("; ", *[F.when(cond, F.lit(reason)) for reason, cond in rules])
    return df.withColumn("reasons", reasons).withColumn("ok", F.col("reasons") == "")


def duplicate_names(products: DataFrame) -> DataFrame:
    """Product names equal ignoring case, with their count and smallest id."""
    return (products.groupBy(F.lower("name").alias("name_key"))
            .agg(F.count(F.lit(1)).alias("n_products"), F.min("id").alias("first_id"))
            .filter(F.col("n_products") > 1))


def constraint_audit(customers: DataFrame, products: DataFrame, orders: DataFrame,
                     items: DataFrame) -> DataFrame:
    """Foreign-key, NOT NULL and UNIQUE audits (parquet enforces none)."""
    def n(df: DataFrame, check: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(check).alias("check_name"), "violations")

    def dup(df: DataFrame, col: Column, check: str) -> DataFrame:
        g = df.groupBy(col.alias("_k")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        return g.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("violations")).select(
            F.lit(check).alias("check_name"), F.col("violations").cast("bigint"))

    checks = [
        n(items.join(orders.select("order_id"), "order_id", "left_anti"), "item_without_order"),
        n(items.join(products.select(F.col("id").alias("product_id")), "product_id", "left_anti"),
          "item_without_product"),
        n(customers.filter(F.col("phone_number").isNull()), "customer_phone_null"),
        n(orders.filter(F.col("customer_phone").isNull()), "order_phone_null"),
        dup(customers, F.col("phone_number"), "customer_phone_duplicate"),
        dup(products, F.col("name"), "product_name_duplicate"),
        dup(orders, F.col("order_id"), "order_id_duplicate"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows removed and added between two snapshots (multiset difference)."""
    removed = before.exceptAll(after).withColumn("change", F.lit("removed"))
    added = after.exceptAll(before).withColumn("change", F.lit("added"))
    return removed.unionByName(added)


def settings_enriched_orders(orders: DataFrame, settings: DataFrame) -> DataFrame:
    """J13 applied: per order the fee and the ETA text from the settings row."""
    j = with_settings(orders, settings)
    fee = delivery_fee(F.col("delivery_type"), F.col("total_amount"), F.col("fee"), F.col("threshold"))
    return j.select("order_id", fee.alias("delivery_fee"),
                    eta_window(F.col("created_at"), F.col("eta_minutes")).alias("eta"))
