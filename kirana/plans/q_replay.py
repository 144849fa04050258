"""Registered queries: ordered change logs over catalog and customers (SNK7, SNK4).

The oracles go through the log one change after the other in a recursive query
whose state is a map (id -> name, phone -> id)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kirana.operators import replay
from kirana.plans import sql_exprs as X
from kirana.plans.base import query
from kirana.sources import tables as tb

# A catalog of unique names and a log from every part: deletes, adds of names taken and
# given up, renames, whole-row updates, and changes to products that the log itself added.
CATALOG_SQL = """
  SELECT p_partkey AS id, p_name || ' ' || p_partkey AS name, p_type AS category, p_retailprice AS price, p_brand AS unit,
         CAST(p_size AS BIGINT) AS stock_quantity FROM part"""
CATALOG_LOG_SQL = """
  SELECT (p_partkey * 7919) % 1000003 AS seq,
         CASE WHEN p_size <= 12 THEN 'delete' WHEN p_size <= 26 THEN 'add' WHEN p_size <= 48 THEN 'update' WHEN p_size = 49 THEN 'delete' ELSE 'remove' END AS op,
         CASE WHEN p_size BETWEEN 13 AND 26 THEN NULL WHEN p_size BETWEEN 40 AND 44 OR p_size = 49 THEN n + (p_partkey * 3) % n // 4
              ELSE (p_partkey * 13) % n + 1 END AS pid,
         CASE WHEN p_size BETWEEN 13 AND 20 THEN upper(other) WHEN p_size BETWEEN 21 AND 25 THEN ' ' || p_name || ' '
              WHEN p_size = 26 THEN '  ' WHEN p_size BETWEEN 27 AND 33 THEN other
              WHEN p_size BETWEEN 34 AND 48 THEN p_name || ' ' || p_brand END AS name,
         CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS category,
         CASE WHEN p_size IN (25, 48) THEN -p_retailprice ELSE p_retailprice END AS price, p_brand AS unit,
         CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS BIGINT) END AS stock_quantity
  FROM (SELECT p.*, m.n, q.p_name || ' ' || q.p_partkey AS other
        FROM part p, (SELECT max(p_partkey) AS n FROM part) m, part q WHERE q.p_partkey = (p.p_partkey * 17) % m.n + 1)"""
CATALOG_STEPS_SQL = f"""
  WITH RECURSIVE ch AS (
    SELECT row_number() OVER (ORDER BY seq) AS k, seq, op, {X.strip("coalesce(name, '')")} AS name, category, price, unit, stock_quantity,
           CASE WHEN op = 'add' THEN (SELECT max(id) FROM v_catalog) + count(*) FILTER (op = 'add') OVER (ORDER BY seq) ELSE pid END AS id,
           pid IN (SELECT product_id FROM v_order_items WHERE quantity >= 50) AS held
    FROM v_catalog_log),
  st(k, names, reason) AS (
    SELECT 0::BIGINT, (SELECT map_from_entries(list((id, name))) FROM v_catalog), 'ok'
    UNION ALL
    SELECT k, CASE WHEN reason <> 'ok' THEN names
                   WHEN op = 'delete' THEN map_from_entries(list_filter(map_entries(names), lambda e: e.key <> id))
                   ELSE map_concat(names, map([id], [name])) END, reason
    FROM (SELECT c.*, s.names,
            CASE WHEN op NOT IN ('add', 'update', 'delete') THEN 'unknown op'
                 WHEN op <> 'delete' AND name = '' THEN 'empty name'
                 WHEN op <> 'delete' AND price < 0 THEN 'negative price'
                 WHEN op = 'add' AND list_contains(list_transform(map_values(s.names), lambda v: lower(v)), lower(name)) THEN 'already exists'
                 WHEN op <> 'add' AND NOT coalesce(list_contains(map_keys(s.names), id), false) THEN 'not found'
                 WHEN op = 'delete' AND held THEN 'used by an order'
                 WHEN op = 'update' AND name <> map_extract(s.names, id)[1] AND list_contains(map_values(s.names), name) THEN 'name taken'
                 ELSE 'ok' END AS reason
          FROM st s JOIN ch c ON c.k = s.k + 1))
  SELECT ch.*, st.reason FROM ch JOIN st ON st.k = ch.k"""
CATALOG_CTES = {"v_catalog": CATALOG_SQL, "v_catalog_log": CATALOG_LOG_SQL, "v_catalog_steps": CATALOG_STEPS_SQL}


def _catalog(spark, d):
    part = tb.read_table(spark, d, "part")
    n = part.agg(F.max("p_partkey")).first()[0]
    named = F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))
    products = part.select(F.col("p_partkey").alias("id"), named.alias("name"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("price"),
                           F.col("p_brand").alias("unit"), F.col("p_size").cast("bigint").alias("stock_quantity"))
    other = part.select(F.col("p_partkey").alias("_o"), named.alias("other"))
    k, size = F.col("p_partkey"), F.col("p_size")
    log = part.join(other.hint("merge"), (k * 17) % n + 1 == F.col("_o")).select(
        ((k * 7919) % 1000003).alias("seq"),
        F.when(size <= 12, "delete").when(size <= 26, "add").when(size <= 48, "update").when(size == 49, "delete").otherwise("remove").alias("op"),
        F.when(~size.between(13, 26), F.when(size.between(40, 44) | (size == 49), F.lit(n) + F.floor((k * 3) % n / 4)).otherwise((k * 13) % n + 1)).cast("bigint").alias("pid"),
        F.when(size.between(13, 20), F.upper("other")).when(size.between(21, 25), F.concat(F.lit(" "), "p_name", F.lit(" "))).when(size == 26, "  ")
         .when(size.between(27, 33), F.col("other")).when(size.between(34, 48), F.concat("p_name", F.lit(" "), "p_brand")).alias("name"),
        F.when(size % 2 == 0, F.col("p_type")).otherwise("").alias("category"),
        F.when(size.isin(25, 48), -F.col("p_retailprice")).otherwise(F.col("p_retailprice")).alias("price"), F.col("p_brand").alias("unit"),
        F.when(size % 3 != 0, size.cast("bigint")).alias("stock_quantity"))
    used = tb.load(spark, d).order_items.filter("quantity >= 50").select("product_id")
    return replay.replay_product_changes(products, log, ["seq"], used)


@query("catalog_verdicts", """SELECT seq, op, CASE WHEN op <> 'add' OR reason = 'ok' THEN id END AS id, name, reason = 'ok' AS accepted, reason
                              FROM v_catalog_steps""", ctes=CATALOG_CTES)
def q_catalog_verdicts(spark, d):
    verdicts, _ = _catalog(spark, d)
    return verdicts.select("seq", "op", "id", F.trim(F.coalesce("name", F.lit(""))).alias("name"), "accepted", "reason")


@query("catalog_after", """
    WITH last AS (SELECT id, max(k) AS k, bool_or(op = 'delete') AS dead FROM v_catalog_steps WHERE reason = 'ok' GROUP BY id),
    rows AS (SELECT s.id, s.name, CASE WHEN trim(category) = '' THEN 'Groceries' ELSE category END AS category, price, unit,
                    CASE WHEN op = 'add' THEN coalesce(stock_quantity, 50) ELSE stock_quantity END AS stock_quantity
             FROM v_catalog_steps s JOIN last USING (k) WHERE NOT dead)
    SELECT * FROM rows UNION ALL SELECT * FROM v_catalog WHERE id NOT IN (SELECT id FROM last)""", ctes=CATALOG_CTES)
def q_catalog_after(spark, d):
    return _catalog(spark, d)[1]


# Every customer and supplier gives one change: registrations in other phone formats, deletes
# of callers that register later, new phones (some taken), new addresses, rows the log inserted.
_B = "CAST(9000000000 + {} AS VARCHAR)"
CALLER_LOG_SQL = f"""
  SELECT (c_custkey * 7919) % 1000003 AS seq, op, CASE op WHEN 'delete' THEN (c_custkey * 17) % n + 1 WHEN 'update' THEN (c_custkey * 13) % n + 1 END AS cid,
         CASE (c_custkey // 3) % 4 WHEN 0 THEN '+91' || b WHEN 1 THEN ' ' || b WHEN 2 THEN '0' || b ELSE substr(b, 1, 5) || ' ' || substr(b, 6, 5) END AS phone,
         CASE WHEN c_acctbal < -800 THEN ' ' ELSE 'N' || c_custkey END AS name, CASE WHEN c_acctbal > 9800 THEN '' ELSE 'Street ' || c_nationkey END AS address
  FROM (SELECT *, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'register' WHEN 'BUILDING' THEN 'delete' WHEN 'FURNITURE' THEN 'update' WHEN 'MACHINERY' THEN 'address'
                       ELSE 'register' END AS op,
               {_B.format("(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN (c_custkey * 31) % (n + 200) + 1 WHEN 'FURNITURE' THEN (c_custkey * 5) % (n + 900) + 1 WHEN 'MACHINERY' THEN c_custkey ELSE (c_custkey * 17) % n + 1 END)")} AS b
        FROM customer, (SELECT max(c_custkey) AS n FROM customer))
  UNION ALL
  SELECT 500000 + s_suppkey, CASE WHEN s_acctbal < 3000 THEN 'delete' WHEN s_acctbal < 9000 THEN 'update' ELSE 'register' END, n + 2 * s_suppkey - 1,
         CASE WHEN s_acctbal < 6000 THEN '12-' || s_nationkey ELSE '' || s_phone_ END, s_name, 'Dock'
  FROM (SELECT *, {_B.format('s_suppkey')} AS s_phone_ FROM supplier, (SELECT max(c_custkey) AS n FROM customer))"""
CALLER_STEPS_SQL = f"""
  WITH RECURSIVE raw AS (
    SELECT row_number() OVER (ORDER BY seq) AS k, seq, op, cid, {X.strip("coalesce(phone, '')")} AS raw, {X.strip("coalesce(name, '')")} AS name, {X.strip("coalesce(address, '')")} AS address,
           (SELECT max(id) FROM v_customers) + 2 * count(*) FILTER (op = 'register') OVER (ORDER BY seq) - 1 AS fresh FROM v_caller_log),
  nrm AS (SELECT *, {X.norm_phone('raw')} AS norm FROM raw),
  ch AS (SELECT *, CASE WHEN length(norm) = 10 THEN '+91' || norm ELSE raw END AS canon,
                CASE WHEN norm <> '' AND (length(norm) = 10 OR norm <> raw) THEN norm END AS alias FROM nrm),
  st(k, phones, target, reason) AS (
    SELECT 0::BIGINT, (SELECT map_from_entries(list((phone_number, id))) FROM v_customers), NULL::BIGINT, 'ok'
    UNION ALL
    SELECT k, CASE WHEN target IS NULL OR op = 'address' THEN phones
                   WHEN op = 'delete' THEN map_from_entries(list_filter(map_entries(phones), lambda e: e.value <> cid))
                   WHEN op = 'update' THEN map_concat(map_from_entries(list_filter(map_entries(phones), lambda e: e.value <> cid)), map([canon], [cid]))
                   WHEN target <> fresh THEN phones
                   WHEN alias IS NULL THEN map_concat(phones, map([canon], [fresh]))
                   ELSE map_concat(phones, map([canon, alias], [fresh, fresh + 1])) END, target, reason
    FROM (SELECT *, CASE WHEN reason <> 'ok' THEN NULL WHEN op = 'register' THEN coalesce(found, fresh) WHEN op = 'address' THEN found ELSE cid END AS target
          FROM (SELECT *, CASE WHEN op IN ('register', 'update') AND name = '' THEN 'empty name'
                               WHEN op = 'register' AND address = '' THEN 'empty address'
                               WHEN op <> 'delete' AND raw = '' THEN 'empty phone'
                               WHEN op IN ('update', 'delete') AND NOT list_contains(map_values(phones), cid) THEN 'not found'
                               WHEN op = 'update' AND coalesce(map_extract(phones, canon)[1], cid) <> cid THEN 'phone taken'
                               WHEN op = 'address' AND found IS NULL THEN 'not found' ELSE 'ok' END AS reason
                FROM (SELECT c.*, s.phones, coalesce(map_extract(s.phones, raw)[1], map_extract(s.phones, norm)[1],
                             map_extract(s.phones, CASE WHEN norm <> '' THEN '+91' || norm ELSE raw END)[1],
                             map_extract(s.phones, CASE WHEN norm <> '' THEN '0' || norm ELSE raw END)[1]) AS found
                      FROM st s JOIN ch c ON c.k = s.k + 1))))
  SELECT ch.*, st.target, st.reason FROM ch JOIN st ON st.k = ch.k"""
CALLER_CTES = {"v_caller_log": CALLER_LOG_SQL, "v_caller_steps": CALLER_STEPS_SQL}


def _callers(spark, d):
    cust, sup = tb.read_table(spark, d, "customer"), tb.read_table(spark, d, "supplier")
    n = cust.agg(F.max("c_custkey")).first()[0]
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")

    def phone(x):
        return (F.lit(9000000000) + x).cast("string")

    b = phone(F.when(seg == "AUTOMOBILE", (k * 31) % (n + 200) + 1).when(seg == "FURNITURE", (k * 5) % (n + 900) + 1).when(seg == "MACHINERY", k).otherwise((k * 17) % n + 1))
    op = F.when(seg == "BUILDING", "delete").when(seg == "FURNITURE", "update").when(seg == "MACHINERY", "address").otherwise("register")
    form = F.floor(k / 3) % 4
    mine = cust.withColumn("b", b).withColumn("op", op).select(
        ((k * 7919) % 1000003).alias("seq"), "op",
        F.when(F.col("op") == "delete", (k * 17) % n + 1).when(F.col("op") == "update", (k * 13) % n + 1).cast("bigint").alias("cid"),
        F.when(form == 0, F.concat(F.lit("+91"), "b")).when(form == 1, F.concat(F.lit(" "), "b")).when(form == 2, F.concat(F.lit("0"), "b"))
         .otherwise(F.concat(F.substring("b", 1, 5), F.lit(" "), F.substring("b", 6, 5))).alias("phone"),
        F.when(F.col("c_acctbal") < -800, " ").otherwise(F.concat(F.lit("N"), k.cast("string"))).alias("name"),
        F.when(F.col("c_acctbal") > 9800, "").otherwise(F.concat(F.lit("Street "), F.col("c_nationkey").cast("string"))).alias("address"))
    bal, s = F.col("s_acctbal"), F.col("s_suppkey")
    theirs = sup.select((F.lit(500000) + s).alias("seq"), F.when(bal < 3000, "delete").when(bal < 9000, "update").otherwise("register").alias("op"),
                        (F.lit(n) + 2 * s - 1).cast("bigint").alias("cid"),
                        F.when(bal < 6000, F.concat(F.lit("12-"), F.col("s_nationkey").cast("string"))).otherwise(phone(s)).alias("phone"),
                        F.col("s_name").alias("name"), F.lit("Dock").alias("address"))
    return replay.replay_customer_changes(tb.load(spark, d).customers, mine.unionByName(theirs), ["seq"])


@query("customer_verdicts", "SELECT seq, op, target AS id, reason = 'ok' AS accepted, reason FROM v_caller_steps", ctes=CALLER_CTES)
def q_customer_verdicts(spark, d):
    return _callers(spark, d)[0].select("seq", "op", "id", "accepted", "reason")


@query("customers_after", """
    WITH done AS (SELECT k, target AS id, op = 'delete' AS gone, CASE WHEN op IN ('register', 'update') THEN name END AS name,
                         CASE WHEN op <> 'delete' THEN address END AS address,
                         CASE WHEN op = 'update' OR (op = 'register' AND target = fresh) THEN canon END AS phone FROM v_caller_steps WHERE reason = 'ok'
                  UNION ALL SELECT k, fresh + 1, false, name, address, alias FROM v_caller_steps
                            WHERE reason = 'ok' AND op = 'register' AND target = fresh AND alias IS NOT NULL),
    now AS (SELECT id, bool_or(gone) AS gone, arg_max(name, k) AS name, arg_max(address, k) AS address, arg_max(phone, k) AS phone FROM done GROUP BY id)
    SELECT coalesce(c.id, n.id) AS id, coalesce(n.phone, c.phone_number) AS phone_number, coalesce(n.name, c.name) AS name, coalesce(n.address, c.address) AS address
    FROM v_customers c FULL OUTER JOIN now n ON n.id = c.id WHERE NOT coalesce(n.gone, false)""", ctes=CALLER_CTES)
def q_customers_after(spark, d):
    return _callers(spark, d)[1]
