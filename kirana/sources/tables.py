"""SRC1: load the fixed-schema tables and bind them to the store model.

Raw tables are read with explicit schemas (no inference) so the scan
prunes columns and pushes filters into parquet.  The ``v_*`` builders
turn the test tables into the store's six tables (see FIXTURES.md §2);
they are plain projections, so Catalyst folds them into the scans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_SCHEMAS: dict[str, str] = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
               "o_orderdate TIMESTAMP, o_orderpriority STRING"),
    "lineitem": ("l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                 "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                 "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP"),
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

TABLE_NAMES = tuple(RAW_SCHEMAS)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_raw_views(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLE_NAMES:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)


# ---------------------------------------------------------------------------
# Binding of the store model to the test tables (FIXTURES.md §2)
# ---------------------------------------------------------------------------

def phone_of(key: Column) -> Column:
    """b(k): the 10-digit phone of customer k."""
    return (F.lit(9000000000) + key).cast("string")


def phone_format(fmt: Column, key: Column) -> Column:
    """Format number 0..3 of b(k): '+91'b, b, '0'b, '+91 ddddd-ddddd'."""
    b = phone_of(key)
    return (F.when(fmt == 0, F.concat(F.lit("+91"), b))
            .when(fmt == 1, b)
            .when(fmt == 2, F.concat(F.lit("0"), b))
            .otherwise(F.concat(F.lit("+91 "), F.substring(b, 1, 5), F.lit("-"), F.substring(b, 6, 5))))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        phone_format(F.col("c_custkey") % 4, F.col("c_custkey")).alias("phone_number"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("address"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
        F.col("p_brand").alias("unit"),
        F.col("p_size").cast("bigint").alias("stock_quantity"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.alias("id"),
        F.concat(F.lit("ORD-"), k.cast("string")).alias("order_id"),
        F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("Caller "), c.cast("string"))).alias("customer_name"),
        phone_format((k + c) % 4, c).alias("customer_phone"),
        F.when(k % 5 == 0, F.lit("pickup")).otherwise(F.lit("delivery")).alias("delivery_type"),
        F.when(k % 3 == 1, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Addr "), c.cast("string"))).alias("delivery_address"),
        F.col("o_totalprice").alias("total_amount"),
        F.when(F.col("o_orderstatus") == "O", "CONFIRMED")
         .when(F.col("o_orderstatus") == "F", "DELIVERED")
         .when(F.col("o_orderstatus") == "P", "CANCELLED").alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("ORD-"), F.col("l_orderkey").cast("string")).alias("order_id"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("subtotal"),
        F.col("l_shipdate").alias("shipped_at"),
        F.col("l_returnflag").alias("return_flag"),
    )


def frames(spark: SparkSession, sf_dir: str, loud_at: float = 50.0) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("call"),
        F.col("event_id"),
        F.col("ts"),
        F.col("value").alias("energy"),
        (F.col("value") >= loud_at).alias("loud"),
    )


def call_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    kind = (F.when(F.col("event_type") == "signup", "start")
            .when(F.col("event_type") == "purchase", "end")
            .when(F.col("event_type") == "error", "interrupt")
            .when(F.col("event_type") == "click", "loud")
            .when(F.col("event_type") == "view", "bot_audio"))
    is_end = F.col("event_type") == "purchase"
    return e.select(
        F.concat(F.lit("CALL-"), F.col("user_id").cast("string")).alias("call_sid"),
        F.col("user_id").alias("call"),
        F.col("event_id"),
        F.col("ts"),
        kind.alias("kind"),
        F.col("value"),
        F.when(is_end, F.col("value")).alias("duration"),
        F.when(is_end & (F.col("event_id") % 2 == 0),
               F.concat(F.lit("ORD-"), F.col("event_id").cast("string"))).alias("order_id"),
    )


def stock_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("bigint")
    return li.select(
        F.col("l_partkey").alias("product_id"),
        F.col("l_shipdate").alias("ts"),
        F.when(F.col("l_returnflag") == "R", q).otherwise(-q).alias("delta"),
        F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey"),
        F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax"), F.col("l_returnflag"),
        F.col("l_linestatus"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations")


@dataclass
class Tables:
    """SRC1 result: the raw tables plus the bound store views."""
    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @property
    def customers(self) -> DataFrame:
        return customers(self.spark, self.sf_dir)

    @property
    def products(self) -> DataFrame:
        return products(self.spark, self.sf_dir)

    @property
    def orders(self) -> DataFrame:
        return orders(self.spark, self.sf_dir)

    @property
    def order_items(self) -> DataFrame:
        return order_items(self.spark, self.sf_dir)

    @property
    def frames(self) -> DataFrame:
        return frames(self.spark, self.sf_dir)

    @property
    def call_events(self) -> DataFrame:
        return call_events(self.spark, self.sf_dir)

    @property
    def stock_moves(self) -> DataFrame:
        return stock_moves(self.spark, self.sf_dir)

    @property
    def turns(self) -> DataFrame:
        return turns(self.spark, self.sf_dir)


def load(spark: SparkSession, sf_dir: str, register_views: bool = False) -> Tables:
    t = Tables(spark, sf_dir)
    if register_views:
        register_raw_views(spark, sf_dir)
        for name in ("customers", "products", "orders", "order_items", "frames",
                     "call_events", "stock_moves", "turns"):
            getattr(t, name).createOrReplaceTempView(f"v_{name}")
    return t


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row count per raw table: one tiny aggregate per table, unioned."""
    parts = [read_table(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(n).alias("table_name"), F.col("n_rows")) for n in TABLE_NAMES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
