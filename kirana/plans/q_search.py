"""Registered queries: catalog search (J12) and item resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from kirana.functions.lexicon import TEST_QUERIES, TEST_SYNONYMS, synonyms_frame
from kirana.functions.sql_functions import register_table_functions
from kirana.functions.text import CATEGORY_WORDS, STOP_WORDS, UNIT_WORDS
from kirana.operators import search as se
from kirana.plans.base import query
from kirana.session import scratch_path
from kirana.sources import tables as tb
from kirana.sources.search_index import build


def _lst(xs):
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


SYN_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{k}', [{_lst(v)}])" for i, (k, v) in enumerate(TEST_SYNONYMS)) + ") s(pos, trigger, terms)"
QUERIES_SQL = ("SELECT q AS qid, q AS query FROM (VALUES " + ", ".join(f"('{q}')" for q in TEST_QUERIES)
               + ") t(q) UNION SELECT 'need ' || p_name, 'need ' || p_name FROM part")
STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def search_sql(qsrc: str) -> str:
    """J12 in DuckDB SQL over a CTE ``{qsrc}(qid, query)``; an independent OR-of-contains formulation."""
    return f"""
    q AS (SELECT qid, query, lower({STRIP.format(x='query')}) AS cq FROM {qsrc}),
    st AS (SELECT q.qid, unnest(s.terms) AS term FROM q JOIN v_synonyms s ON contains(q.cq, s.trigger)),
    wf AS (SELECT qid, word FROM (SELECT qid, unnest(regexp_extract_all(cq, '[\\p{{L}}\\p{{N}}_]+')) AS word FROM q)
           WHERE word NOT IN ({_lst(STOP_WORDS)})),
    terms0 AS (SELECT qid, term FROM st UNION SELECT qid, word FROM wf WHERE length(word) > 1),
    terms AS (SELECT qid, term FROM terms0
              UNION SELECT qid, word FROM wf WHERE qid NOT IN (SELECT qid FROM terms0)),
    pr AS (SELECT id, name, lower(name) AS nk, lower(category) AS ck FROM v_products WHERE stock_quantity > 0),
    hits AS (SELECT DISTINCT t.qid, pr.id, pr.name, pr.nk FROM terms t JOIN pr
             ON contains(pr.nk, t.term) OR (t.term IN ({_lst(CATEGORY_WORDS)}) AND contains(pr.ck, t.term))),
    ranked AS (SELECT h.qid, h.id, h.name, row_number() OVER (PARTITION BY h.qid ORDER BY
                 CASE WHEN starts_with(h.nk, q.cq) THEN 1 WHEN contains(h.nk, q.cq) THEN 2 ELSE 3 END, h.name, h.id)
                 AS rank FROM hits h JOIN q ON q.qid = h.qid),
    found AS (SELECT qid, rank, id, name, 'match' AS match FROM ranked WHERE rank <= 10),
    stk AS (SELECT id, name, row_number() OVER (ORDER BY id) AS rank FROM pr QUALIFY rank <= 10),
    nohit AS (SELECT qid, qid IN (SELECT qid FROM terms) AS has_terms FROM q WHERE qid NOT IN (SELECT qid FROM found)),
    fb AS (SELECT n.qid, s.rank, s.id, s.name, CASE WHEN n.has_terms THEN 'fallback' ELSE 'default' END AS match
           FROM nohit n, stk s WHERE s.rank <= CASE WHEN n.has_terms THEN 5 ELSE 10 END),
    search_result AS (SELECT * FROM found UNION ALL SELECT * FROM fb)"""


def _queries(spark, d):
    fixed = spark.createDataFrame([(q, q) for q in TEST_QUERIES], "qid STRING, query STRING")
    part = tb.read_table(spark, d, "part").select(F.concat(F.lit("need "), F.col("p_name")).alias("qid"))
    return fixed.unionByName(part.select("qid", F.col("qid").alias("query"))).distinct()


@query("search_catalog", "WITH " + search_sql("v_queries") + "\nSELECT qid, rank, id, name, match FROM search_result",
       ctes={"v_queries": QUERIES_SQL, "v_synonyms": SYN_SQL})
def q_search_catalog(spark, d):
    t = tb.load(spark, d)
    return se.search_catalog(_queries(spark, d), t.products, synonyms_frame(spark, TEST_SYNONYMS)).select(
        "qid", F.col("rank").cast("bigint").alias("rank"), "id", "name", "match")


@query("search_terms", f"""
    SELECT qid, list_sort(list_distinct(list(term))) AS terms_sorted FROM (
    WITH {search_sql('v_queries').split('pr AS')[0].rstrip().rstrip(',')}
    SELECT * FROM terms) GROUP BY qid
    UNION ALL SELECT qid, [] FROM v_queries WHERE false""", ctes={"v_queries": QUERIES_SQL, "v_synonyms": SYN_SQL})
def q_search_terms(spark, d):
    ex = se.expand_terms(_queries(spark, d), synonyms_frame(spark, TEST_SYNONYMS))
    return ex.filter(F.size("terms") > 0).select("qid", F.array_sort("terms").alias("terms_sorted"))


REQ_SQL = """SELECT DISTINCT name, product_id FROM (
  SELECT CASE WHEN l.l_returnflag = 'A' THEN upper(p.p_name)
              WHEN l.l_returnflag = 'N' AND l.l_linestatus = 'O' THEN p.p_name || ' 1kg'
              WHEN l.l_returnflag = 'N' THEN split_part(p.p_name, ' ', 2) || ' ' || split_part(p.p_name, ' ', 1)
              ELSE 'fresh ' || split_part(p.p_name, ' ', 2) END AS name,
         CASE WHEN l.l_linenumber = 1 THEN l.l_partkey END AS product_id
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey)"""


def _requests(spark, d):
    li = tb.read_table(spark, d, "lineitem")
    p = tb.read_table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    w = F.split("p_name", " ")
    name = (F.when(F.col("l_returnflag") == "A", F.upper("p_name"))
            .when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), F.concat("p_name", F.lit(" 1kg")))
            .when(F.col("l_returnflag") == "N", F.concat(w[1], F.lit(" "), w[0]))
            .otherwise(F.concat(F.lit("fresh "), w[1])))
    r = li.join(p, "l_partkey").select(name.alias("name"),
                                       F.when(F.col("l_linenumber") == 1, F.col("l_partkey")).alias("product_id"))
    r = r.distinct()
    return r.withColumn("line_id", F.concat_ws("|", "name", F.coalesce(F.col("product_id").cast("string"), F.lit(""))))


RESOLVE_SQL = "WITH " + search_sql("v_rq") + f""",
    r AS (SELECT name || '|' || coalesce(CAST(product_id AS VARCHAR), '') AS line_id, name, product_id,
                 {STRIP.format(x='name')} AS rq, lower({STRIP.format(x='name')}) AS rk FROM v_requests),
    p AS (SELECT id, name AS pname, lower(name) AS nk, stock_quantity AS st FROM v_products),
    t1 AS (SELECT r.line_id, p.id, 1 AS tier FROM r JOIN p ON p.id = r.product_id),
    t2 AS (SELECT r.line_id, min(p.id) AS id, 2 AS tier FROM r JOIN p ON p.nk = r.rk WHERE r.rq <> '' GROUP BY 1),
    tok AS (SELECT line_id, rq, rk, list_filter(string_split_regex(rq, '\\s+'), lambda t: t <> '' AND length(t) > 1
              AND NOT regexp_matches(t, '^[0-9]+$') AND lower(t) NOT IN ({_lst(UNIT_WORDS)})) AS toks
            FROM r WHERE rq <> ''),
    t3 AS (SELECT tok.line_id, arg_min(p.id, (CASE WHEN p.nk = tok.rk THEN 1 WHEN contains(p.nk, tok.rk) THEN 2
                    ELSE 3 END, p.id)) AS id, 3 AS tier
           FROM tok JOIN p ON len(tok.toks) > 0
             AND len(list_filter(tok.toks, lambda t: NOT contains(p.nk, lower(t)))) = 0 GROUP BY 1),
    t4 AS (SELECT r.line_id, s.id, 4 AS tier FROM r JOIN search_result s ON s.qid = r.rq
           WHERE s.rank = 1 AND s.match = 'match'),
    t5 AS (SELECT tok.line_id, arg_min(p.id, (-p.st, p.id)) AS id, 5 AS tier
           FROM tok JOIN p ON len(tok.toks) > 1
             AND len(list_filter(tok.toks, lambda t: contains(p.nk, lower(t)))) > 0 GROUP BY 1),
    best AS (SELECT line_id, arg_min(id, (tier, id)) AS matched_id, min(tier) AS match_tier FROM (
               SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3
               UNION ALL SELECT * FROM t4 UNION ALL SELECT * FROM t5) GROUP BY line_id)
    SELECT r.line_id, b.matched_id, b.match_tier, p.pname AS matched_name, p.st AS available
    FROM r LEFT JOIN best b ON b.line_id = r.line_id LEFT JOIN p ON p.id = b.matched_id"""


RESOLVE_CTES = {
    "v_requests": REQ_SQL, "v_synonyms": SYN_SQL,
    "v_rq": "SELECT DISTINCT regexp_replace(name, '^\\s+|\\s+$', '', 'g') AS qid, "
            "regexp_replace(name, '^\\s+|\\s+$', '', 'g') AS query FROM v_requests"}


@query("resolve_products", RESOLVE_SQL, ctes=RESOLVE_CTES)
def q_resolve_products(spark, d):
    t = tb.load(spark, d)
    res = se.resolve_products(_requests(spark, d), t.products, synonyms_frame(spark, TEST_SYNONYMS))
    return res.select("line_id", "matched_id", F.col("match_tier").cast("int").alias("match_tier"),
                      "matched_name", "available")


@query("stock_check_by_name", """
    SELECT v.line_id, v.matched_id AS product_id, v.match_tier, 2 * length(v.line_id) AS requested,
           v.matched_name AS product_name, v.available,
           coalesce(v.available >= 2 * length(v.line_id), false) AS in_stock,
           greatest(0, 2 * length(v.line_id) - v.available) AS shortfall
    FROM v_resolution v""", ctes={**RESOLVE_CTES, "v_resolution": RESOLVE_SQL})
def q_stock_check_by_name(spark, d):
    t = tb.load(spark, d)
    asked = _requests(spark, d).withColumn("quantity", (2 * F.length("line_id")).cast("string"))
    return se.stock_check_by_name(asked, t.products, synonyms_frame(spark, TEST_SYNONYMS)).select(
        "line_id", "product_id", F.col("match_tier").cast("int").alias("match_tier"),
        F.col("requested").cast("bigint").alias("requested"), "product_name", "available", "in_stock",
        F.col("shortfall").cast("bigint").alias("shortfall"))


FEW_SQL = "SELECT q AS qid, q AS query FROM (VALUES " + ", ".join(f"('{q}')" for q in TEST_QUERIES) + ") t(q)"


@query("register_table_functions", "WITH " + search_sql("v_few") + f"""
    SELECT qid, rank, id, name, match FROM search_result
    UNION ALL SELECT customer_phone, NULL, id, order_id, status FROM v_orders WHERE customer_phone IN ('09000000007', '9000000007', '+919000000007')""",
       ctes={"v_few": FEW_SQL, "v_synonyms": SYN_SQL})
def q_register_table_functions(spark, d):
    """Both SQL table functions: searches on a stored index, and one caller's orders."""
    t = tb.load(spark, d)
    path = scratch_path(spark, "search-index")
    build(t.products, path)
    synonyms_frame(spark, TEST_SYNONYMS).createOrReplaceTempView("kirana_synonyms")
    t.orders.createOrReplaceTempView("kirana_orders")
    register_table_functions(spark, "kirana_orders", path, "kirana_synonyms")
    found = " UNION ALL ".join(f"SELECT '{q}' AS qid, * FROM kirana_search_catalog('{q}')" for q in TEST_QUERIES)
    theirs = """SELECT h.customer_phone AS qid, CAST(NULL AS BIGINT) AS rank, o.id, h.order_id AS name, h.status AS match
                FROM kirana_order_history('09000000007') h JOIN kirana_orders o ON o.order_id = h.order_id"""
    return spark.sql(f"{found} UNION ALL {theirs}")
