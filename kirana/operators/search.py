"""Catalog search and item-name resolution (S8, S9, J12, J4, K2, K3, A5 by name).

The reference builds ``LOWER(name) LIKE '%term%' OR ...`` per query.  Here
a whole table of queries is matched at once:

* substrings are found with an **n-gram equi-join**: a needle of length L is
  inside a text only if the text contains the needle's first min(3, L)
  characters, so needles join the distinct texts' 1-3-grams on that prefix
  (a hash join, AQE splits hot grams) and the candidates are verified with
  ``contains``.  No needle x text cross product is formed.  Terms are found
  in product names this way, and synonym triggers in queries;
* products of one name and category are one catalog entry until the end, and
  a term keeps its first ``k`` entries before it meets the queries, so what is
  ranked per query does not grow with the catalog;
* the first ``k`` per group is ``row_number() <= k``, which Spark cuts to ``k``
  rows a group in every task before the shuffle.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kirana.functions.phone import py_strip
from kirana.functions.text import CATEGORY_WORDS, search_terms, search_tokens, significant_tokens
from kirana.operators.orders import stock_check
from kirana.session import written

GRAM = 3


def topk_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int,
                   rank_col: str = "rank") -> DataFrame:
    """Top ``k`` rows per group by ``order``, ranked from 1."""
    return (df.withColumn(rank_col, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
            .filter(F.col(rank_col) <= k))


def name_grams(names: DataFrame, col: str = "name_key") -> DataFrame:
    """Distinct (name, n, gram) for every substring of length 1..3 of each name."""
    n = F.length(F.col(col))
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    g = names.select(col, F.explode(starts).alias("_i"))
    out = None
    for k in range(1, GRAM + 1):
        part = (g.filter(F.col("_i") + (k - 1) <= F.length(F.col(col)))
                .select(col, F.lit(k).alias("_n"), F.substring(F.col(col), F.col("_i"), F.lit(k)).alias("_gram")))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def substring_pairs(terms: DataFrame, names: DataFrame, term_col: str = "term",
                    name_col: str = "name_key") -> DataFrame:
    """All (term, name) with ``term`` a substring of ``name`` (both distinct sets),
    via the n-gram prefix equi-join plus ``contains`` verification."""
    t = terms.select(term_col).distinct().filter(F.length(term_col) > 0)
    t = t.select(term_col, F.least(F.length(term_col), F.lit(GRAM)).alias("_n"),
                 F.substring(F.col(term_col), 1, GRAM).alias("_gram"))
    g = name_grams(names.select(name_col).distinct(), name_col)
    return (t.join(g, ["_n", "_gram"])
            .filter(F.col(name_col).contains(F.col(term_col)))
            .select(term_col, name_col))


def expand_terms(queries: DataFrame, synonyms: DataFrame, qid: str = "qid", text: str = "query") -> DataFrame:
    """S8 + S9 + X1: per query the cleaned text and the ordered, de-duplicated
    term list (synonym terms in dictionary order, then the query's words)."""
    q = queries.select(qid, text, F.lower(py_strip(F.col(text))).alias("clean_q"))
    hits = (substring_pairs(synonyms, q, "trigger", "clean_q").join(synonyms, "trigger")
            .groupBy("clean_q").agg(F.sort_array(F.collect_list(F.struct("pos", "terms"))).alias("_syn")))
    q = q.join(hits, "clean_q", "left")
    syn_terms = F.flatten(F.transform(F.coalesce("_syn", F.array().cast("array<struct<pos:int,terms:array<string>>>")),
                                      lambda s: s["terms"]))
    words = search_terms(F.col("clean_q"))
    strict = F.filter(words, lambda w: F.length(w) > 1)
    syn_n = F.size(syn_terms)
    terms = F.array_distinct(F.concat(syn_terms, F.when(syn_n > 0, strict).otherwise(words)))
    return q.select(qid, text, "clean_q", terms.alias("terms"))


def search_catalog(queries: DataFrame, products: DataFrame, synonyms: DataFrame, k: int = 10,
                   fallback_n: int = 5, default_n: int = 10, qid: str = "qid", text: str = "query") -> DataFrame:
    """Ranked catalog matches per query.

    In-stock products whose lower-cased name contains any term (or whose
    category does, for category words) ranked by prefix (1) / phrase (2) /
    other (3), then name, then id; top ``k`` per query.  Queries with terms
    but no match get the first ``fallback_n`` in-stock products, queries with
    no terms the first ``default_n`` (ids ascending, ``match='fallback'`` /
    ``'default'``).

    An entry is a (name, category) with its smallest id.  A query's first ``k``
    products lie in its first ``k`` entries, and those are among the first
    ``k`` of each of its terms (rank 3: all entries of the term that come
    earlier are hits too) or the first ``k`` that contain the whole query."""
    # the terms are used in several branches: written once, under the shared checkpoint folder
    ex, _ = written(expand_terms(queries, synonyms, qid, text), "search-terms")
    p = products.filter(F.col("stock_quantity") > 0).select("id", "name", "category")
    entries = (p.groupBy("name", "category").agg(F.min("id").alias("first_id"))
               .withColumns({"name_key": F.lower("name"), "cat_key": F.lower("category")}))
    cats = F.array(*[F.lit(c) for c in CATEGORY_WORDS])
    cols = ["name", "category", "name_key", "first_id"]

    # the first k entries of each distinct term, by name and by category
    qt = ex.select(qid, "clean_q", F.explode("terms").alias("term"))
    cat_terms = qt.filter(F.array_contains(cats, F.col("term")))
    by_name = substring_pairs(qt, entries).join(entries, "name_key").select("term", *cols)
    by_cat = substring_pairs(cat_terms, entries, "term", "cat_key").join(entries, "cat_key").select("term", *cols)
    by_term_order = [F.col("name"), F.col("first_id")]
    per_term = topk_per_group(by_name, ["term"], by_term_order, k).unionByName(
        topk_per_group(by_cat, ["term"], by_term_order, k))
    by_terms = qt.join(per_term, "term").select(qid, "clean_q", *cols)

    # the first k entries whose name holds the whole query, hits by its terms
    phrases = ex.select("clean_q", "terms").distinct()
    is_hit = F.exists("terms", lambda t: F.col("name_key").contains(t)
                      | (F.array_contains(cats, t) & F.coalesce(F.col("cat_key").contains(t), F.lit(False))))
    whole = (substring_pairs(phrases, entries, "clean_q", "name_key").join(phrases, "clean_q")
             .join(entries, "name_key").filter(is_hit))
    whole = topk_per_group(whole, ["clean_q"], [~F.col("name_key").startswith(F.col("clean_q")), *by_term_order], k)
    by_phrase = ex.select(qid, "clean_q").join(whole.select("clean_q", *cols), "clean_q")

    rank_case = (F.when(F.col("name_key").startswith(F.col("clean_q")), 1)
                 .when(F.col("name_key").contains(F.col("clean_q")), 2).otherwise(3))
    cand = by_terms.unionByName(by_phrase.select(qid, "clean_q", *cols)).distinct()
    cand = topk_per_group(cand.withColumn("match_rank", rank_case), [qid],
                          [F.col("match_rank"), *by_term_order], k)
    ids = topk_per_group(p, ["name", "category"], [F.col("id")], k).select(
        "id", F.col("name").alias("_n"), F.col("category").alias("_c"))
    hits = cand.drop("rank").join(ids, F.col("name").eqNullSafe(F.col("_n")) & F.col("category").eqNullSafe(F.col("_c")))
    ranked = topk_per_group(hits, [qid], [F.col("match_rank"), F.col("name"), F.col("id")], k)
    found = ranked.select(qid, "rank", "id", "name", F.lit("match").alias("match"))
    # fallbacks: a bounded (<= default_n rows) listing attached to the queries without results
    in_stock = p.select("id", "name").orderBy("id").limit(max(fallback_n, default_n))
    in_stock = in_stock.withColumn("rank", F.row_number().over(Window.orderBy("id")))
    no_hit = ex.join(found.select(qid).distinct(), qid, "left_anti").select(
        qid, (F.size("terms") > 0).alias("_has_terms"))
    fb = (no_hit.crossJoin(F.broadcast(in_stock))
          .filter(F.col("rank") <= F.when(F.col("_has_terms"), fallback_n).otherwise(default_n))
          .select(qid, "rank", "id", "name",
                  F.when(F.col("_has_terms"), F.lit("fallback")).otherwise(F.lit("default")).alias("match")))
    return found.unionByName(fb)


def resolve_products(lines: DataFrame, products: DataFrame, synonyms: DataFrame,
                     key: str = "line_id", name_col: str = "name", id_col: str = "product_id",
                     strict_reference: bool = False) -> DataFrame:
    """J4 + W1 + K3: order line -> product by tier.

    1 ``id`` given and known; 2 exact case-insensitive name (smallest id);
    3 every significant token contained (equal name 1, phrase 2, else 3; id);
    4 first catalog-search result (a real match; the reference's arbitrary
    in-stock fallback only with ``strict_reference``); 5 any significant
    token, most stock then id.  Work for tiers 2-5 is done once per distinct
    requested name, against one row per product name, and joined back; the
    catalog search runs for the names that tiers 2 and 3 leave open.
    """
    p = products.select(F.col("id").alias("_pid"), F.col("name").alias("_pname"),
                        F.lower("name").alias("name_key"), F.col("stock_quantity").alias("_stock"))
    per_name = p.groupBy("name_key").agg(
        F.min("_pid").alias("_first"),
        F.min(F.struct((-F.col("_stock")).alias("_s"), F.col("_pid"))).alias("_most"))
    ln = lines.select(key, F.col(name_col).alias("_req"), F.col(id_col).alias("_rid"))
    # tier 1
    t1 = ln.join(p, ln["_rid"] == p["_pid"]).select(key, "_pid", F.lit(1).alias("tier"))
    # distinct requested names
    names = ln.select(py_strip(F.col("_req")).alias("req")).filter(F.col("req") != "").distinct()
    names = names.withColumn("req_key", F.lower("req"))
    # tier 2: exact CI name
    t2 = (names.join(per_name, names["req_key"] == per_name["name_key"])
          .select("req", F.col("_first").alias("_pid"), F.lit(2).alias("tier")))
    # tiers 3 and 5: the significant tokens a product name holds, all or any
    toks = names.select("req", "req_key", significant_tokens(F.col("req")).alias("_toks"))
    words = F.array_distinct(F.transform("_toks", lambda t: F.lower(t)))
    tok = toks.select("req", "req_key", F.size("_toks").alias("_nt"), F.size(words).alias("_nd"),
                      F.explode(words).alias("term"))
    held = (tok.join(substring_pairs(tok, per_name), "term")
            .groupBy("req", "req_key", "_nt", "_nd", "name_key").agg(F.count(F.lit(1)).alias("_m"))
            .join(per_name, "name_key"))
    r3 = (F.when(F.col("name_key") == F.col("req_key"), 1)
          .when(F.col("name_key").contains(F.col("req_key")), 2).otherwise(3))
    by_tokens = held.groupBy("req").agg(
        F.min(F.when(F.col("_m") == F.col("_nd"), F.struct(r3.alias("_r"), F.col("_first").alias("_pid")))).alias("_all"),
        F.min(F.when(F.col("_nt") > 1, F.col("_most"))).alias("_any"))
    t35 = by_tokens.select(
        "req", F.coalesce("_all._pid", "_any._pid").alias("_pid"),
        F.when(F.col("_all").isNotNull(), 3).otherwise(5).alias("tier")).filter(F.col("_pid").isNotNull())
    # tier 4: first catalog search result, for names without a better tier
    settled = t2.select("req").unionByName(t35.filter("tier = 3").select("req"))
    sq = names.join(settled, "req", "left_anti").select(F.col("req").alias("qid"), F.col("req").alias("query"))
    sr = search_catalog(sq, products, synonyms, k=1)
    if not strict_reference:
        sr = sr.filter(F.col("match") == "match")
    t4 = sr.filter(F.col("rank") == 1).select(F.col("qid").alias("req"), F.col("id").alias("_pid"),
                                              F.lit(4).alias("tier"))
    best_name = (t2.unionByName(t35).unionByName(t4).groupBy("req")
                 .agg(F.min(F.struct("tier", "_pid")).alias("_b")))
    ln2 = ln.withColumn("req", py_strip(F.col("_req")))
    via_name = ln2.join(best_name, "req").select(key, F.col("_b._pid").alias("_pid"), F.col("_b.tier").alias("tier"))
    best = t1.unionByName(via_name).groupBy(key).agg(F.min(F.struct("tier", "_pid")).alias("_b"))
    res = ln.join(best, key, "left").select(key, F.col("_b._pid").alias("matched_id"),
                                            F.col("_b.tier").alias("match_tier"))
    return res.join(p.select(F.col("_pid").alias("matched_id"), F.col("_pname").alias("matched_name"),
                             F.col("_stock").alias("available")), "matched_id", "left")


def stock_check_by_name(requests: DataFrame, products: DataFrame, synonyms: DataFrame, key: str = "line_id",
                        name_col: str = "name", id_col: str = "product_id", qty_col: str = "quantity",
                        floor_one: bool = False) -> DataFrame:
    """A5 for spoken names: each request's product is found as in J4, then requested
    and available units are compared; ``reason`` is "not found" for unknown names."""
    found = resolve_products(requests, products, synonyms, key, name_col, id_col)
    asked = requests.select(key, F.col(name_col).alias("requested_name"), F.col(qty_col).alias("quantity"))
    asked = asked.join(found.select(key, F.col("matched_id").alias("product_id"), "match_tier"), key, "left")
    return stock_check(asked, products, "quantity", floor_one)
