"""Dashboard and daily KPIs.

Money is summed as DECIMAL(18,2) so totals do not depend on the order
partial sums are combined in; the results are cast to DOUBLE at the end.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW_STOCK = 10


def money_sum(c: Column) -> Column:
    return F.sum(c.cast("decimal(18,2)"))


def money_round(c: Column) -> Column:
    """2 decimals, exact (decimal first, then round)."""
    return F.round(c.cast("decimal(38,6)"), 2).cast("double")


def dashboard_kpis(customers: DataFrame, products: DataFrame, orders: DataFrame,
                   today: _dt.date | str) -> DataFrame:
    """A1: one row of store KPIs; three one-row aggregates cross-joined."""
    day = F.lit(today).cast("date")
    c = customers.agg(F.count(F.lit(1)).alias("total_customers"))
    p = products.agg(F.count(F.lit(1)).alias("total_products"),
                     F.coalesce(F.sum(F.when(F.col("stock_quantity") <= LOW_STOCK, 1).otherwise(0)),
                                F.lit(0)).cast("bigint").alias("low_stock_count"))
    is_today = F.to_date("created_at") == day
    live = F.col("status") != "CANCELLED"
    o = orders.agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.coalesce(F.sum(F.when(is_today, 1).otherwise(0)), F.lit(0)).cast("bigint").alias("orders_today"),
        F.coalesce(money_sum(F.when(is_today & live, F.col("total_amount")).otherwise(0.0)),
                   F.lit(0)).alias("_rev_today"),
        F.coalesce(money_sum(F.when(live, F.col("total_amount")).otherwise(0.0)),
                   F.lit(0)).alias("_rev_total"))
    return (c.crossJoin(p).crossJoin(o)
            .select("total_customers", "total_products", "low_stock_count", "total_orders", "orders_today",
                    money_round(F.col("_rev_today")).alias("revenue_today"),
                    money_round(F.col("_rev_total")).alias("total_revenue")))


def daily_kpis(orders: DataFrame) -> DataFrame:
    """A2: the "today" slice for every day (one shuffle on the date)."""
    live = F.col("status") != "CANCELLED"
    return (orders.groupBy(F.to_date("created_at").alias("day"))
            .agg(F.count(F.lit(1)).alias("orders"),
                 F.sum(F.when(live, 1).otherwise(0)).cast("bigint").alias("live_orders"),
                 money_sum(F.when(live, F.col("total_amount")).otherwise(0.0)).alias("_rev"))
            .select("day", "orders", "live_orders", money_round(F.col("_rev")).alias("revenue")))


def stock_band(stock: Column) -> Column:
    return (F.when(stock <= 0, "out").when(stock <= LOW_STOCK, "low").otherwise("ok"))


def kpi_rollup(products: DataFrame) -> DataFrame:
    """A3: products by category and stock band with subtotals and a grand total."""
    return (products.withColumn("band", stock_band(F.col("stock_quantity")))
            .rollup("category", "band")
            .agg(F.count(F.lit(1)).alias("n_products"),
                 F.sum(F.when(F.col("stock_quantity") <= LOW_STOCK, 1).otherwise(0)).cast("bigint")
                 .alias("low_stock"),
                 F.sum("stock_quantity").alias("units"),
                 F.grouping_id().alias("level")))
