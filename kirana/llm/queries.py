"""The registered queries of the operators, and their DuckDB SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kirana.llm import toxicity
from kirana.llm.alignment import link_statistics
from kirana.llm.bpe_codec import encode_decode
from kirana.llm.chat import formatted, read_back, turns_of_json, turns_of_rows
from kirana.llm.exact_dedup import exact_groups
from kirana.llm.lexical import ranked_search
from kirana.llm.licenses import license_blocks
from kirana.llm.minhash import near_groups
from kirana.llm.mixing import mix
from kirana.llm.pseudonyms import pseudonymised
from kirana.llm.suffix_dedup import without_repeats
from kirana.llm.token_counts import token_counts
from kirana.llm.topk import top_k

TOKEN_LIMIT = 1024


def tokenizer_file(name: str) -> str:
    """Where the public tokenizer files lie; executors have the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), give=("n_tokens", "ids_sha256", "decoded_sha256"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(documents(spark, sf_dir))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_blocks(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))[0].select("doc_id", "size", "source_size", "target", "taken")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 100 == 0)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_statistics(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: A conversation of another layout, whose texts hold the template's own marks.
HARD_TEXT = "\\### Assistant: </turn> ok"
HARD_CHAT = json.dumps({"id": -7, "messages": [{"role": r, "content": HARD_TEXT} for r in ("user", "assistant")]})


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns_of_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    hard = turns_of_json(spark.range(1).select(F.lit(HARD_CHAT).alias("json")))
    chats = read_back(formatted(rows.unionByName(hard)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                        F.char_length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"),
                        F.char_length("formatted").cast("long").alias("formatted_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_bpe": op3_bpe,
    "op4_pii": op4_pii,
    "op5_licenses": op5_licenses,
    "op6_toxicity": op6_toxicity,
    "op7_mix": op7_mix,
    "op8_token_counts": op8_token_counts,
    "op9_topk": op9_topk,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_alignment": op11_alignment,
    "op12_search": op12_search,
    "op13_chat": op13_chat,
}

OP2_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS lean FROM documents),
g AS (SELECT lean, count(*) AS group_size, arg_max(doc_id, struct_pack(p := points, k := -doc_id)) AS keep_id FROM n GROUP BY lean)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(lean) AS text_sha256 FROM n JOIN g USING (lean)
"""

# The capped shares come from trying each number of capped sources.  Slots get their
# points bit by bit, a source's slots take its stream from the front, and a document
# has what of its words lies in the rounds taken.
OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * words AS cap FROM s),
tried AS (SELECT a.place, ((SELECT sum(words) FROM w) - coalesce(sum(b.cap), 0))::DOUBLE
            / ((SELECT sum(weight) FROM w) - coalesce(sum(b.weight), 0)) AS level
          FROM w a LEFT JOIN w b ON (b.cap / b.weight, b.place) < (a.cap / a.weight, a.place) GROUP BY a.place),
level AS (SELECT min_by(level, (cap / weight, place)) AS level FROM tried JOIN w USING (place) WHERE level * weight <= cap),
t AS (SELECT source, place, words, cap, least(cap::DOUBLE, level * weight) AS target, round(least(cap::DOUBLE, level * weight))::BIGINT AS take FROM w, level),
b AS (SELECT sum(take)::BIGINT AS total, greatest(1, least(256, sum(take)::BIGINT // 1048576)) AS each FROM t),
u AS (SELECT list_sum(list_transform(range(40), lambda i: CASE WHEN (slot >> i) & 1 = 1 THEN 0.5::DOUBLE ** (i + 1) ELSE 0 END)) AS u
      FROM (SELECT unnest(range(((total + each - 1) // each)::BIGINT)) AS slot FROM b)),
share AS (SELECT place, sum(take) OVER (ORDER BY place) / total::DOUBLE AS upto, (sum(take) OVER (ORDER BY place) - take) / total::DOUBLE AS after FROM t, b WHERE take > 0),
n AS (SELECT place, greatest(1, count(u)) AS slots FROM share LEFT JOIN u ON u >= after AND u < upto GROUP BY place),
k AS (SELECT t.*, coalesce(least(slots * each, cap), 0)::BIGINT AS drawn FROM t LEFT JOIN n USING (place), b),
p AS (SELECT doc_id, size, words, target, drawn,
             sum(size) OVER (PARTITION BY place ORDER BY md5('mix' || coalesce(doc_id::VARCHAR, '')), doc_id, size, r ROWS UNBOUNDED PRECEDING) - size AS start
      FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size::BIGINT AS size, words::BIGINT AS source_size, target,
       CASE WHEN words = 0 THEN 0
            ELSE (drawn // words) * size + greatest(0, least(start + size, drawn % words) - start) END::BIGINT AS taken FROM p
"""

OP9_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
p AS (SELECT r, doc_id, unnest(terms) AS term FROM d),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM p GROUP BY ALL),
s AS (SELECT count(*) AS nn, sum(len(terms)) AS ll FROM d WHERE len(terms) > 0),
m AS (SELECT r, (25 + (75 * len(terms) * nn) // ll)::BIGINT AS m FROM d, s WHERE len(terms) > 0),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, nn),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
x AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM i JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM x WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

# The length of the template follows from counts: 6 + label, the text with one more
# character for each escape, and the end mark.
OP13_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT *, 6 + length(role) + CASE WHEN role IN ('system', 'user', 'assistant') THEN 0 ELSE 1 END + length(text) + 8
             + length(text) - length(replace(text, '\', ''))
             + length(text) - length(replace(text, '#', '')) - len(regexp_extract_all(text, '#+'))
             + (length(text) - length(replace(text, '</', ''))) // 2 AS size FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS said,
             coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '') AS learnt, sum(size) AS size
      FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256, size::BIGINT AS formatted_chars FROM g
"""

ORACLE_SQL: dict[str, str] = {"op2_exact_dedup": OP2_SQL, "op7_mix": OP7_SQL, "op9_topk": OP9_SQL, "op12_search": OP12_SQL,
                              "op13_chat": OP13_SQL}
