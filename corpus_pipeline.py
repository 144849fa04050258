"""A corpus pipeline over the operators of ``kirana.llm``.

``STAGES`` are applied in order; each one's result is written as Parquet under
the shared checkpoint folder and read again as the next one's ``docs``.  All
but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kirana.llm import toxicity
from kirana.llm.bpe_codec import encode_decode
from kirana.llm.common import squeezed, stage
from kirana.llm.exact_dedup import exact_groups
from kirana.llm.minhash import near_groups
from kirana.llm.mixing import MOST, mark, mix
from kirana.llm.queries import tokenizer_file


def _keep(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of the documents that a decision keeps."""
    ids = decisions.filter("kept").select(F.col("doc_id").alias("its")).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("its")), "left_semi")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, learnt from the labels, does not reject."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; rows that repeat an id and text become one."""
    decisions = stage(exact_groups(docs), "exact-groups")
    kept = _keep(docs, decisions)
    if decisions.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        kept = kept.withColumn("_lean", squeezed(F.col("text"))).dropDuplicates(["doc_id", "_lean"]).drop("_lean")
    return kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near duplicates."""
    return _keep(docs, near_groups(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the order of the schedule's slots: whole, in each
    round of its source's stream in which the slots take at least half of it.

    Documents without words are no part of a mix of words and go; a document of a source that the
    schedule draws less than once, and beyond what it draws, goes too."""
    mixed, _ = mix(docs)
    middle = F.col("start") + F.floor(F.col("size") / 2)
    times = sum((((middle + F.lit(k) * F.col("source_size")) < F.col("source_take")).cast("int") for k in range(MOST)), F.lit(0))
    drawn = mixed.filter("size > 0").select(F.col("doc_id").alias("its"), F.col("source").alias("of"), F.col("mark").alias("said"), times.alias("times"), "first_slot")
    found = docs.join(drawn.filter("times > 0"), F.col("doc_id").eqNullSafe(F.col("its")) & F.col("source").eqNullSafe(F.col("of"))
                      & (mark(F.col("text")) == F.col("said")))
    found = found.withColumn("_round", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return found.orderBy("_round", "first_slot").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of them and of their decoding."""
    return encode_decode(docs, tokenizer_file("word_bpe_49k.json"), give=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
