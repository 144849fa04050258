"""Exact duplicates by progressive refinement (operator 2), DataFrame functions only.

Documents are grouped by the length of their normalised text; only lengths
that occur more than once go on to a hash of the first ``PREFIX`` characters;
only those that still share both are grouped by the SHA-256 of the whole
normalised text.  Each level joins counts that were summed before the shuffle;
the rows that travel hold lengths and hashes, never texts.  Each level has a key
of its own (the prefix hash is taken with the length), so the counts of a level
don't take the partitions of the join before, where a common length or a large
group of copies would be one task: they are summed first and then dealt out.

The scan that measures the texts takes the SHA-256 in the same pass, since
the result states it for every document and a second read of the survivors'
texts would shuffle them; only survivors are compared by it.

Defined results: a null text counts as empty, and empty texts are equal.  The
copy with the most code points stays, then the smallest key; a null key comes
last.  Rows that repeat a key and text are copies of one another: they count
in ``group_size`` and carry the same ``keep_id``.  An empty table returns no
rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kirana.llm.common import prepare, squeezed, stage

PREFIX = 64


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, code points, and the three levels: length, prefix hash, SHA-256."""
    lean = docs.select(F.col(key).alias("key"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("points"), squeezed(F.col(text)).alias("lean"))
    return lean.select("key", "points", F.length("lean").alias("size"), F.xxhash64(F.length("lean"), F.substring("lean", 1, PREFIX)).alias("head"),
                       F.sha2(F.encode("lean", "utf-8"), 256).alias("sha"))


def _repeated(rows: DataFrame, level: str) -> DataFrame:
    """Rows whose value of ``level`` occurs more than once."""
    return rows.join(rows.groupBy(level).agg(F.count("*").alias("n")).filter("n > 1").select(level), level, "left_semi")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the key, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    prepare(docs.sparkSession)
    rows = stage(signatures(docs, key, text), "signatures")
    by_head = _repeated(_repeated(rows, "size"), "head")
    order = F.struct("points", F.col("key").isNotNull(), -F.col("key"))
    groups = (by_head.groupBy("sha")
              .agg(F.count("*").alias("n"), F.max_by("key", order).alias("keep")).filter("n > 1"))
    keep = F.when(F.col("n").isNull(), F.col("key")).otherwise(F.col("keep"))
    return (rows.join(groups.select("sha", "n", "keep"), "sha", "left")
            .select(F.col("key").alias(key), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                    F.col("key").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256")))
