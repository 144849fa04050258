"""Registered queries: change-set sinks, schema evolution, snapshot diff, settings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kirana.functions.phone import py_strip
from kirana.operators.orders import snapshot_diff
from kirana.plans.base import REGISTRY, query
from kirana.plans import sql_exprs as X
from kirana.plans.q_store import RESOLVE_SQL
from kirana.session import scratch_path
from kirana.sources import sinks as sk
from kirana.sources import tables as tb
from kirana.sources.events import event_stream, write_events
from kirana.sources.settings import DEFAULT_SETTINGS, SETTING_DEFAULTS, setting_value, settings_frame, settings_map, upsert_settings

CHANGES_SQL = """
  SELECT p_name AS name, lower(p_type) AS category,
         CAST(round(CAST(p_retailprice AS DECIMAL(18,2)) * 1.05, 2) AS DOUBLE) AS price, p_brand AS unit,
         CAST(p_size AS BIGINT) AS stock_quantity, p_partkey AS seq FROM part WHERE p_size <= 10
  UNION ALL SELECT s_name, 'SUPPLY', s_acctbal, 'each', CAST(s_nationkey AS BIGINT), 1000000000 + s_suppkey
  FROM supplier"""
UPSERT_SQL = """
  SELECT p.id, coalesce(p.name, c.name) AS name, coalesce(c.c_category, p.category) AS category,
         coalesce(c.c_price, p.price) AS price, coalesce(c.c_unit, p.unit) AS unit,
         CASE WHEN p.id IS NOT NULL THEN p.stock_quantity ELSE c.c_stock END AS stock_quantity
  FROM v_products p FULL OUTER JOIN (
    SELECT name, arg_max(category, seq) AS c_category, arg_max(price, seq) AS c_price, arg_max(unit, seq) AS c_unit,
           arg_min(stock_quantity, seq) AS c_stock FROM v_changes GROUP BY name) c ON c.name = p.name"""


def _catalog_changes(spark, d):
    p = tb.read_table(spark, d, "part").filter(F.col("p_size") <= 10).select(
        F.col("p_name").alias("name"), F.lower("p_type").alias("category"),
        F.round(F.col("p_retailprice").cast("decimal(18,2)") * F.lit(1.05).cast("decimal(3,2)"), 2).cast("double")
        .alias("price"), F.col("p_brand").alias("unit"), F.col("p_size").cast("bigint").alias("stock_quantity"),
        F.col("p_partkey").alias("seq"))
    s = tb.read_table(spark, d, "supplier").select(
        F.col("s_name").alias("name"), F.lit("SUPPLY").alias("category"), F.col("s_acctbal").alias("price"),
        F.lit("each").alias("unit"), F.col("s_nationkey").cast("bigint").alias("stock_quantity"),
        (F.lit(1000000000) + F.col("s_suppkey")).alias("seq"))
    return p.unionByName(s)


def _upserted(spark, d):
    return sk.upsert_catalog(tb.load(spark, d).products, _catalog_changes(spark, d))


@query("upsert_catalog", "SELECT * FROM v_upsert", ctes={"v_changes": CHANGES_SQL, "v_upsert": UPSERT_SQL})
def q_upsert_catalog(spark, d):
    return _upserted(spark, d)


@query("snapshot_diff", """
    (SELECT *, 'removed' AS change FROM (SELECT * FROM v_products EXCEPT ALL SELECT * FROM v_upsert))
    UNION ALL
    (SELECT *, 'added' AS change FROM (SELECT * FROM v_upsert EXCEPT ALL SELECT * FROM v_products))""",
       ctes={"v_changes": CHANGES_SQL, "v_upsert": UPSERT_SQL})
def q_snapshot_diff(spark, d):
    before = tb.load(spark, d).products
    after = _upserted(spark, d).select(*before.columns)
    return snapshot_diff(before, after)


@query("insert_if_absent", """
    SELECT id, phone_number, name, address FROM v_customers
    UNION ALL
    SELECT NULL AS id, customer_phone, arg_min_null(customer_name, (created_at, id)),
           arg_min_null(delivery_address, (created_at, id))
    FROM v_orders WHERE customer_phone NOT IN (SELECT phone_number FROM v_customers) GROUP BY customer_phone""")
def q_insert_if_absent(spark, d):
    t = tb.load(spark, d)
    rows = t.orders.select(F.col("customer_phone").alias("phone_number"), F.col("customer_name").alias("name"),
                           F.col("delivery_address").alias("address"), "created_at", F.col("id").alias("oid"))
    out = sk.insert_if_absent(t.customers, rows, "phone_number", ["created_at", "oid"])
    return out.select("id", "phone_number", "name", "address")


def _valid(x):
    return f"{X.strip(f'coalesce({x}, chr(0))')}"


@query("apply_customer_changes", f"""
    WITH r AS (SELECT o.id AS oid, o.created_at, o.customer_phone AS phone, {X.strip('o.customer_name')} AS n,
                      {X.strip('o.delivery_address')} AS a, v.customer_id
               FROM v_orders o JOIN v_res v ON v.id = o.id
               WHERE {X.strip("coalesce(o.customer_name, '')")} <> '' AND {X.strip("coalesce(o.delivery_address, '')")} <> ''
                 AND {X.strip("coalesce(o.customer_phone, '')")} <> ''),
    upd AS (SELECT customer_id, arg_max(n, (created_at, oid)) AS n, arg_max(a, (created_at, oid)) AS a
            FROM r WHERE customer_id IS NOT NULL GROUP BY customer_id),
    kept AS (SELECT c.id, c.phone_number, coalesce(u.n, c.name) AS name, coalesce(u.a, c.address) AS address
             FROM v_customers c LEFT JOIN upd u ON u.customer_id = c.id),
    fr AS (SELECT *, {X.norm_phone(X.strip('phone'))} AS norm FROM r WHERE customer_id IS NULL),
    fr2 AS (SELECT CASE WHEN length(norm) = 10 THEN '+91' || norm ELSE {X.strip('phone')} END AS canon,
                   created_at, oid, n, a, norm FROM fr),
    best AS (SELECT canon, arg_max(n, (created_at, oid)) AS n, arg_max(a, (created_at, oid)) AS a,
                    arg_max(norm, (created_at, oid)) AS norm FROM fr2 GROUP BY canon),
    ins AS (SELECT DISTINCT NULL::BIGINT AS id, ph AS phone_number, n AS name, a AS address FROM (
              SELECT canon AS ph, n, a FROM best WHERE canon <> ''
              UNION ALL SELECT norm, n, a FROM best WHERE norm <> '' AND norm <> canon)
            WHERE ph NOT IN (SELECT phone_number FROM kept))
    SELECT * FROM kept UNION ALL SELECT * FROM ins""", ctes={"v_res": RESOLVE_SQL})
def q_apply_customer_changes(spark, d):
    t = tb.load(spark, d)
    ch = t.orders.select(F.lit("register").alias("op"), F.col("customer_phone").alias("phone"),
                         F.col("customer_name").alias("name"), F.col("delivery_address").alias("address"),
                         "created_at", F.col("id").alias("oid"))
    return sk.register_latest(t.customers, ch, ["created_at", "oid"]).select(
        "id", "phone_number", "name", "address")


@query("evolve_schema", "SELECT *, CAST(NULL AS VARCHAR) AS estimated_delivery_time FROM v_orders")
def q_evolve_schema(spark, d):
    o = tb.load(spark, d).orders
    target = T.StructType(o.schema.fields + [T.StructField("estimated_delivery_time", T.StringType(), True)])
    return sk.evolve_schema(o, target)


CRUD_SQL = """
  SELECT 'add' AS op, CAST(NULL AS BIGINT) AS pid, s_name AS name, s_acctbal AS price, s_suppkey AS seq FROM supplier
  UNION ALL SELECT 'add', NULL, upper(p_name), p_retailprice, 100000000 + p_partkey FROM part WHERE p_size = 1
  UNION ALL SELECT 'update', p_partkey + 7, p_name, p_retailprice - 1500, 200000000 + p_partkey FROM part
            WHERE p_size = 2
  UNION ALL SELECT 'delete', p_partkey * 2, NULL, NULL, 300000000 + p_partkey FROM part WHERE p_size = 3"""


@query("catalog_crud", f"""
    WITH c AS (SELECT *, lower({X.strip("coalesce(name, '')")}) AS k FROM v_crud),
    fa AS (SELECT k, min(seq) AS first_seq FROM c WHERE op = 'add' AND k <> '' AND NOT coalesce(price < 0, false) GROUP BY k),
    j AS (SELECT c.*, c.k IN (SELECT lower(name) FROM v_products) AS ex, c.pid IN (SELECT id FROM v_products) AS known,
                 fa.first_seq FROM c LEFT JOIN fa ON fa.k = c.k),
    rs AS (SELECT *, CASE WHEN op <> 'delete' AND k = '' THEN 'empty name'
                          WHEN op <> 'delete' AND price < 0 THEN 'negative price'
                          WHEN op = 'add' AND (ex OR seq <> first_seq) THEN 'already exists'
                          WHEN op <> 'add' AND NOT coalesce(known, false) THEN 'not found' END AS r FROM j)
    SELECT op, pid, name, price, seq, r IS NULL AS accepted, coalesce(r, 'ok') AS reason FROM rs""",
       ctes={"v_crud": CRUD_SQL})
def q_catalog_crud(spark, d):
    part = tb.read_table(spark, d, "part")
    sup = tb.read_table(spark, d, "supplier")
    ch = (sup.select(F.lit("add").alias("op"), F.lit(None).cast("bigint").alias("pid"), F.col("s_name").alias("name"),
                     F.col("s_acctbal").alias("price"), F.col("s_suppkey").alias("seq"))
          .unionByName(part.filter("p_size = 1").select(F.lit("add").alias("op"), F.lit(None).cast("bigint").alias("pid"),
                       F.upper("p_name").alias("name"), F.col("p_retailprice").alias("price"),
                       (F.lit(100000000) + F.col("p_partkey")).alias("seq")))
          .unionByName(part.filter("p_size = 2").select(F.lit("update").alias("op"), (F.col("p_partkey") + 7).alias("pid"),
                       F.col("p_name").alias("name"), (F.col("p_retailprice") - 1500).alias("price"),
                       (F.lit(200000000) + F.col("p_partkey")).alias("seq")))
          .unionByName(part.filter("p_size = 3").select(F.lit("delete").alias("op"), (F.col("p_partkey") * 2).alias("pid"),
                       F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("price"),
                       (F.lit(300000000) + F.col("p_partkey")).alias("seq"))))
    return sk.apply_product_changes(tb.load(spark, d).products, ch, ["seq"])


SET_VALUES = ", ".join(f"('{k}', '{v}', '{desc}')" for k, v, desc in DEFAULT_SETTINGS)


@query("upsert_settings", f"""
    WITH s AS (SELECT * FROM (VALUES {SET_VALUES}) t(key, value, description)),
    c AS (SELECT {X.strip('event_type')} AS key, arg_max({X.strip('CAST(value AS VARCHAR)')}, event_id) AS new_value,
                 max(ts) AS changed_at FROM events WHERE value IS NOT NULL GROUP BY 1)
    SELECT coalesce(s.key, c.key) AS key, coalesce(c.new_value, s.value) AS value,
           coalesce(s.description, '') AS description,
           CASE WHEN c.new_value IS NOT NULL THEN c.changed_at END AS updated_at
    FROM s FULL OUTER JOIN c ON c.key = s.key""")
def q_upsert_settings(spark, d):
    e = tb.read_table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("value").cast("string").alias("value"),
                                                F.col("event_id").alias("seq"), "ts")
    return upsert_settings(settings_frame(spark), e)


@query("settings_map", REGISTRY["upsert_settings"].sql)
def q_settings_map(spark, d):
    e = tb.read_table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("value").cast("string").alias("value"),
                                                F.col("event_id").alias("seq"), "ts")
    m = settings_map(upsert_settings(settings_frame(spark), e))
    m = m.select(F.explode("settings").alias("key", "value"), "details")
    return m.select("key", "value", F.col("details")[F.col("key")]["description"].alias("description"),
                    F.col("details")[F.col("key")]["updated_at"].alias("updated_at"))


_ASKED = ("store_name", "delivery_fee", "purchase", "store_phone", "no_such_key")


@query("setting_value", f"""
    SELECT e.event_id, k.key, coalesce(s.value, d.value, 'none') AS value
    FROM (SELECT event_id, event_id % {len(_ASKED)} AS n FROM events) e
    JOIN (VALUES {', '.join(f"({n}, '{k}')" for n, k in enumerate(_ASKED))}) k(n, key) ON k.n = e.n
    LEFT JOIN v_new_settings s ON s.key = k.key
    LEFT JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in SETTING_DEFAULTS.items())}) d(key, value) ON d.key = k.key""",
       ctes={"v_new_settings": REGISTRY["upsert_settings"].sql})
def q_setting_value(spark, d):
    """S19 for every event: settings after the upsert, the defaults, and a default of the caller's."""
    e = tb.read_table(spark, d, "events")
    changes = e.select(F.col("event_type").alias("key"), F.col("value").cast("string").alias("value"), F.col("event_id").alias("seq"), "ts")
    table = upsert_settings(settings_frame(spark), changes).select(F.col("key"), "value")
    named = table.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("settings"))  # one row: as many keys as there are settings
    asked = F.element_at(F.array(*map(F.lit, _ASKED)), (F.col("event_id") % len(_ASKED) + 1).cast("int"))
    return (e.select("event_id", asked.alias("key")).crossJoin(F.broadcast(named))
            .select("event_id", "key", setting_value(F.col("settings"), F.concat(F.lit(" "), "key", F.lit(" ")), "none").alias("value")))


@query("event_stream", "SELECT coalesce(kind, 'bad line') AS kind, count(*) AS n_events FROM (SELECT kind FROM v_call_events UNION ALL SELECT NULL FROM events WHERE value IS NOT NULL AND event_type = 'signup') GROUP BY 1")
def q_event_stream(spark, d):
    """SRC2 with a stop between: a first run over some of the files, a second over the rest with the same checkpoint."""
    e = tb.load(spark, d).call_events
    path, out = scratch_path(spark, "events"), scratch_path(spark, "events-sink")
    cut = F.col("event_id") % 2 == 0

    def run() -> None:
        q = (event_stream(spark, path, 2).writeStream.format("parquet").option("checkpointLocation", f"{out}-ckpt").option("path", out).trigger(availableNow=True).start())
        q.awaitTermination()

    write_events(e.filter(cut), path)
    run()
    write_events(e.filter(~cut), path)
    # lines that are no events: a sign-up cut short in the middle
    broken = tb.read_table(spark, d, "events").filter("value IS NOT NULL AND event_type = 'signup'")
    broken.select(F.concat(F.lit('{"event": "start", "event_id": '), F.col("event_id").cast("string")).alias("value")).write.mode("append").text(path)
    run()
    return spark.read.parquet(out).groupBy(F.coalesce("kind", F.lit("bad line")).alias("kind")).agg(F.count(F.lit(1)).alias("n_events"))


@query("write_orders", """
    SELECT o.order_id, 'b0001' AS batch_id, o.customer_phone, o.total_amount, i.n_items
    FROM v_orders o LEFT JOIN (SELECT order_id, count(*) AS n_items FROM v_order_items GROUP BY 1) i
      ON i.order_id = o.order_id WHERE o.status <> 'CANCELLED'""")
def q_write_orders(spark, d):
    t = tb.load(spark, d)
    live = t.orders.filter(F.col("status") != "CANCELLED").select("order_id", "customer_phone", "total_amount")
    items = t.order_items.join(live.select("order_id"), "order_id", "left_semi").select(
        "order_id", "product_id", "quantity", "unit_price", "subtotal")
    path = scratch_path(spark, "orders-sink")
    sk.write_orders(live, items, path, "b0001")
    o, i = sk.read_orders(spark, path)
    return o.join(i.groupBy("order_id", "batch_id").agg(F.count(F.lit(1)).alias("n_items")),
                  ["order_id", "batch_id"], "left").select(
        "order_id", F.col("batch_id").cast("string").alias("batch_id"), "customer_phone", "total_amount", "n_items")
