"""Tool calls in model replies.

A reply table is parsed with regex + JSON functions (no Python), the calls
are counted per tool, and a table of calls is run in one order of time: each name
goes to the set-at-a-time operator that implements it, and what depends on earlier
calls (callers, stock, orders) is replayed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kirana.functions.phone import py_strip
from kirana.functions.text import (
    address_default, delivery_fee, extract_tool_json, name_default, normalize_items, safe_quantity, tool_arguments, tool_name)
from kirana.operators.orders import with_settings
from kirana.operators.replay import replay_customer_changes, replay_orders
from kirana.operators.search import resolve_products, search_catalog
from kirana.session import written

# The tool names the assistant may call.
KNOWN_TOOLS = ["register_caller", "search_catalog", "check_stock", "place_order", "track_order",
               "cancel_existing_order"]


def extract_tool_calls(replies: DataFrame, text_col: str = "text") -> DataFrame:
    """S13 over a table: the tool name and JSON arguments found in each reply (NULL when none)."""
    j = extract_tool_json(F.col(text_col))
    return replies.withColumn("_j", j).select(
        *replies.columns, tool_name(F.col("_j")).alias("tool"), tool_arguments(F.col("_j")).alias("arguments"))


def tool_usage(calls: DataFrame) -> DataFrame:
    """Calls per tool name, split known/unknown and by arguments that parse as an object."""
    known = F.col("tool").isin(*KNOWN_TOOLS)
    args_ok = F.json_object_keys(F.col("arguments")).isNotNull()
    return (calls.filter(F.col("tool").isNotNull())
            .groupBy("tool")
            .agg(F.count(F.lit(1)).alias("n_calls"),
                 F.sum(args_ok.cast("int")).cast("bigint").alias("n_args_ok"))
            .withColumn("known", known))


def order_items_table(calls: DataFrame, items_col: str = "items") -> DataFrame:
    """S14 over a table: one row per normalised item of each call."""
    return calls.select(*[c for c in calls.columns if c != items_col],
                        F.posexplode(normalize_items(F.col(items_col))).alias("item_pos", "item"))


def tool_batch(calls: DataFrame, customers: DataFrame, products: DataFrame, orders: DataFrame, items: DataFrame, settings: DataFrame,
               synonyms: DataFrame, order: Sequence[str]) -> DataFrame:
    """A table of tool calls (call_id, tool, arguments, caller_phone and the columns of
    ``order``) run in that order, with one row each: ``ok``, ``reason`` and typed results,
    and all of them as JSON in ``result``.

    * ``register_caller`` goes through SNK4; ``place_order`` takes its customer's name and
      address from the profile of then where it gives none (S16), finds its products as J4
      does in the catalog before the batch, is accepted or not by the stock of then, and
      costs A4's total with the fee of S10 at the present settings; the order's id is
      ``ORD-C`` and the call's id.
    * ``check_stock`` (A5), ``track_order`` (FIL5) and ``cancel_existing_order`` (O2) see
      the stock and the orders of then; ``search_catalog`` (J12) the catalog before the batch.

    Arguments that are no JSON object count as ``{}``, a missing phone as the caller's;
    an unknown name gives an error row."""
    given = F.when(F.json_object_keys(F.col("arguments")).isNotNull(), F.col("arguments")).otherwise(F.lit("{}"))

    def arg(name: str) -> Column:
        return F.get_json_object(F.col("_args"), f"$.{name}")

    blank = F.lit("")
    c = calls.withColumn("_args", given).select(
        "call_id", "tool", *[o for o in order if o not in ("call_id", "tool")],
        F.coalesce(F.when(arg("customer_phone") != "", arg("customer_phone")), F.col("caller_phone"), blank).alias("phone"),
        F.coalesce(arg("customer_name"), blank).alias("name"), F.coalesce(arg("delivery_address"), blank).alias("address"),
        F.lower(F.coalesce(arg("delivery_type"), F.lit("delivery"))).alias("delivery_type"), F.coalesce(arg("items"), F.lit("[]")).alias("items"),
        F.coalesce(arg("product_name"), blank).alias("product_name"), F.coalesce(arg("quantity"), F.lit("1")).alias("quantity"),
        F.coalesce(arg("query"), blank).alias("query"),
        F.when(F.col("tool") == "place_order", F.concat(F.lit("ORD-C"), F.col("call_id").cast("string"))).otherwise(F.coalesce(arg("order_id"), blank)).alias("order_id"))
    c, _ = written(c, "tool-calls")

    # customers: registrations, and the profile that each order finds
    people = c.filter(F.col("tool").isin("register_caller", "place_order")).select(
        "call_id", *order, F.when(F.col("tool") == "register_caller", "register").otherwise("lookup").alias("op"), "phone", "name", "address")
    seen = replay_customer_changes(customers, people, order)[0]
    seen = seen.select("call_id", F.col("op").alias("_op"), F.col("id").alias("customer_id"), F.col("reason").alias("_person"), F.col("name").alias("_name"), F.col("address").alias("_address"))

    # lines of orders and stock checks, their products found by name
    wanted = (c.filter("tool = 'place_order'").select("call_id", F.posexplode(normalize_items(F.col("items"))).alias("pos", "i")).select("call_id", "pos", "i.name", "i.quantity")
              .unionByName(c.filter("tool = 'check_stock'").select("call_id", F.lit(0).alias("pos"), F.col("product_name").alias("name"), "quantity")))
    wanted = wanted.withColumn("line_id", F.concat_ws("|", F.col("call_id").cast("string"), F.col("pos").cast("string"))).withColumn("_no_id", F.lit(None).cast("bigint"))
    wanted, _ = written(wanted, "tool-lines")
    found = resolve_products(wanted, products, synonyms, "line_id", "name", "_no_id").select("line_id", F.col("matched_id").alias("product_id"))
    lines = wanted.join(found.hint("merge"), "line_id", "left").select(F.col("call_id").alias("request_id"), "pos", "product_id", safe_quantity(F.col("quantity")).alias("quantity"))
    lines, _ = written(lines, "tool-lines")

    op = F.create_map(*[F.lit(x) for x in ("place_order", "place", "check_stock", "check", "track_order", "track", "cancel_existing_order", "cancel")])
    requests = c.withColumn("op", F.try_element_at(op, F.col("tool"))).filter("op is not null").select(F.col("call_id").alias("request_id"), *order, "op", "order_id")
    verdicts, tried, _ = replay_orders(requests, lines, orders, items, products, order)
    verdicts = verdicts.select(F.col("request_id").alias("call_id"), "before", "outcome")

    price = products.select(F.col("id").alias("product_id"), F.col("price").cast("decimal(18,2)").alias("_price"))
    sums = lines.join(price.hint("merge"), "product_id").groupBy(F.col("request_id").alias("call_id")).agg(F.sum(F.col("_price") * F.col("quantity").cast("decimal(18,0)")).alias("_sub"))
    checked = tried.filter("pos = 0").select(F.col("request_id").alias("call_id"), "product_id", "available")
    hits = search_catalog(c.filter("tool = 'search_catalog'").select(F.col("call_id").alias("qid"), "query"), products, synonyms)
    hits = hits.groupBy(F.col("qid").alias("call_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda h: h["id"]).alias("products"))

    j = (with_settings(c, settings).join(seen.hint("merge"), "call_id", "left").join(verdicts.hint("merge"), "call_id", "left").join(sums.hint("merge"), "call_id", "left").join(checked.hint("merge"), "call_id", "left").join(hits.hint("merge"), "call_id", "left"))
    placed, of = F.col("outcome") == "accepted", lambda t: F.col("tool") == t
    known = F.coalesce(F.col("tool").isin(*KNOWN_TOOLS), F.lit(False))
    ok = (F.when(~known, F.lit(False)).when(of("register_caller"), F.col("_person") == "ok").when(of("search_catalog"), F.lit(True))
          .otherwise(F.col("outcome").isin("accepted", "in stock", "found", "cancelled")))
    reason = (F.when(~known, F.concat(F.lit("Unknown tool name: "), F.coalesce("tool", blank))).when(of("register_caller"), F.col("_person"))
              .when(of("search_catalog"), F.lit("ok")).otherwise(F.col("outcome")))
    fee = delivery_fee(F.col("delivery_type"), F.col("_sub").cast("double"), F.col("fee"), F.col("threshold"))
    name = name_default(F.col("name"), F.col("_name"))
    home = address_default(F.col("delivery_type"), F.col("address"), F.col("_address"))
    typed = j.select(
        "call_id", "tool", F.coalesce(ok, F.lit(False)).alias("ok"), reason.alias("reason"),
        F.when(of("register_caller") | placed, F.col("customer_id")).alias("customer_id"),
        F.when(placed, name).when(of("register_caller") & ok, py_strip(F.col("name"))).alias("customer_name"),
        F.when(placed, home).when(of("register_caller") & ok, py_strip(F.col("address"))).alias("address"),
        F.when(placed | of("track_order") | of("cancel_existing_order"), F.upper(py_strip(F.col("order_id")))).alias("order_id"),
        F.when(placed, F.lit("CONFIRMED")).when(of("track_order"), F.col("before")).when(F.col("outcome") == "cancelled", F.lit("CANCELLED")).alias("status"),
        F.when(placed, (F.col("_sub").cast("double") + fee).cast("decimal(18,2)").cast("double")).alias("total_amount"),
        F.when(of("check_stock"), F.col("product_id")).alias("product_id"), F.when(of("check_stock"), F.col("available")).alias("available"),
        F.when(of("search_catalog"), F.coalesce("products", F.array().cast("array<bigint>"))).alias("products"))
    return typed.withColumn("result", F.to_json(F.struct(*typed.columns[2:])))
