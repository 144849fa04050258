"""A stored n-gram index of the in-stock catalog, for searches from SQL.

``build`` writes one row for each (gram, product name): the 1- to 3-grams of the
lower-cased name, the category words that the name's categories hold, and the few products
that a search without result lists.  Rows are sorted by gram, so a search reads the row
groups of its terms' first grams and not the catalog; a name carries its first ``K``
products, which is all that a result of ``K`` rows can show of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kirana.functions.text import CATEGORY_WORDS, STOP_WORDS
from kirana.operators.search import GRAM, name_grams

K = 10
#: Kinds of rows besides the lengths of grams: category words, first products.
BY_CATEGORY, LISTED = 0, -1


def build(products: DataFrame, path: str) -> None:
    """Write the index of ``products`` (id, name, category, stock_quantity) to a new folder."""
    p = products.filter(F.col("stock_quantity") > 0).select("id", "name", F.lower("name").alias("name_key"), F.lower("category").alias("cat_key"))
    first = Window.partitionBy("name").orderBy("id")
    names = (p.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= K)
             .groupBy("name_key", "name").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    by_gram = name_grams(p.select("name_key").distinct()).join(names, "name_key").select("_n", "_gram", "name_key", "name", "ids")
    word = F.explode(F.filter(F.array(*map(F.lit, CATEGORY_WORDS)), lambda w: F.col("cat_key").contains(w)))
    kept = p.select("id", "name", "name_key", word.alias("_gram")).withColumn("_r", F.row_number().over(Window.partitionBy("_gram", "name").orderBy("id"))).filter(F.col("_r") <= K)
    by_category = kept.groupBy("_gram", "name_key", "name").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("_n", F.lit(BY_CATEGORY))
    listed = p.orderBy("id").limit(K).select(F.lit(LISTED).alias("_n"), F.lit("").alias("_gram"), "name_key", "name", F.array("id").alias("ids"))
    rows = by_gram.unionByName(by_category).unionByName(listed).select(F.col("_n").alias("n"), F.col("_gram").alias("gram"), "name_key", "name", "ids")
    rows.repartitionByRange("n", "gram").sortWithinPartitions("n", "gram").write.parquet(path)


def register(spark: SparkSession, path: str, synonyms_view: str, index_view: str = "kirana_search_index") -> None:
    """``kirana_search_catalog(q)``: rank, id, name and match, as J12 gives them, from the index at ``path``.

    ``synonyms_view`` has pos, trigger and terms."""
    spark.read.parquet(path).createOrReplaceTempView(index_view)
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
    spark.sql(rf"""
        CREATE OR REPLACE TEMPORARY FUNCTION kirana_search_catalog(q STRING)
        RETURNS TABLE (rank BIGINT, id BIGINT, name STRING, match STRING)
        RETURN
        WITH c AS (SELECT lower(regexp_replace(q, '^\\s+|\\s+$', '')) AS cq),
        words AS (SELECT cq, filter(regexp_extract_all(cq, '[\\p{{L}}\\p{{N}}_]+', 0), w -> w NOT IN ({stop})) AS loose FROM c),
        said AS (SELECT DISTINCT t.term FROM (SELECT explode(s.terms) AS term FROM {synonyms_view} s, c WHERE contains(c.cq, s.trigger)) t),
        strict AS (SELECT explode(filter(loose, w -> length(w) > 1)) AS term FROM words),
        terms AS (SELECT term FROM said UNION SELECT term FROM strict
                  UNION SELECT term FROM (SELECT explode(loose) AS term FROM words) WHERE (SELECT count(*) FROM said) + (SELECT count(*) FROM strict) = 0),
        hits AS (SELECT i.name_key, i.name, i.ids FROM terms t JOIN {index_view} i
                   ON i.n = least(length(t.term), {GRAM}) AND i.gram = substring(t.term, 1, {GRAM}) WHERE contains(i.name_key, t.term)
                 UNION SELECT i.name_key, i.name, i.ids FROM terms t JOIN {index_view} i ON i.n = {BY_CATEGORY} AND i.gram = t.term),
        ranked AS (SELECT DISTINCT CASE WHEN startswith(h.name_key, c.cq) THEN 1 WHEN contains(h.name_key, c.cq) THEN 2 ELSE 3 END AS m, h.name, h.id
                   FROM (SELECT name_key, name, explode(ids) AS id FROM hits) h, c),
        found AS (SELECT row_number() OVER (ORDER BY m, name, id) AS rank, id, name, 'match' AS match FROM ranked),
        listed AS (SELECT row_number() OVER (ORDER BY ids[0]) AS rank, ids[0] AS id, name,
                          CASE WHEN (SELECT count(*) FROM terms) > 0 THEN 'fallback' ELSE 'default' END AS match FROM {index_view} WHERE n = {LISTED})
        SELECT CAST(rank AS BIGINT) AS rank, id, name, match FROM found WHERE rank <= {K}
        UNION ALL SELECT CAST(rank AS BIGINT), id, name, match FROM listed
          WHERE (SELECT count(*) FROM ranked) = 0 AND rank <= CASE WHEN match = 'fallback' THEN 5 ELSE {K} END""")
