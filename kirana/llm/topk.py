"""Exact top-k by inner product over norm buckets (operator 9).

Vectors are made integers, ``floor(scale * x)``, held in doubles (exact at any size), and grouped by length: bucket b
holds those whose length is within a factor ``STEP`` of the next; a bucket is
split into blocks of about ``BLOCK`` rows.  Queries form blocks too.

1. Each query block meets one block of its dimension's longest bucket; its
   k-th best score there bounds its k-th best score from below.
2. Any other block is skipped when the product of lengths can't reach
   the least bound of the query block.  In the blocks that are left, each
   query's bound gives a local cosine threshold.  Where it is at least
   ``COORDINATES_FROM``, vectors are pruned by their direction in the query's
   heaviest coordinates, elsewhere by their length.
3. Products of the vectors left are computed exactly and the best k kept.

Blocks are joined by number, one row for each pair of blocks that may matter;
no task gets more than a pair of blocks, and k rows a query leave it.

Defined results: vectors that are null, empty, or hold null or non-finite
components take no part, nor do those with a null key; a component that is no longer
finite after scaling, or a score among the best k that doesn't fit a long, raises an
error.  Only vectors of equal dimension are compared.  Rows that repeat a key and vector count once;
rows of one key with different vectors are queries and candidates of their own, each with its k
rows, in order of their vectors; equal scores are ordered by the smaller key; an empty table returns no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kirana.llm.common import prepare, stage

STEP = 1.1
BLOCK, QUERY_BLOCK = 4096, 512
COORDINATES_FROM = 0.3
#: Heaviest coordinates of a query that prune.
FOCUS = 3
#: Doubles from here on are whole numbers.
WHOLE = float(1 << 53)
TOO_LARGE = "a score does not fit a long"


def integers(vector: Column, scale: int) -> Column:
    def whole(x: Column) -> Column:
        y = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(y) < WHOLE, F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, whole)


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def _packed(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """Rows (key, v, length, ...) gathered into blocks of about ``most`` rows of one group."""
    sizes = rows.groupBy(*by).agg(F.ceil(F.count("*") / most).alias("blocks"))
    dealt = rows.join(sizes, by).withColumn("part", F.pmod(F.xxhash64("key"), F.col("blocks")))
    return (dealt.groupBy(*by, "part").agg(F.array_sort(F.collect_list(F.struct("key", "v"))).alias("rows"), F.max("length").alias("longest"), F.min("length").alias("shortest"))
            .withColumn("number", F.xxhash64(*by, "part")))


def _matrix(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of a block."""
    flat = rows.flatten() if pa.types.is_list(rows.type) else rows
    keys, vectors = flat.field("key"), flat.field("v")
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    return keys.to_numpy(zero_copy_only=False), values.reshape(len(keys), -1)


def _whole(values: np.ndarray) -> np.ndarray:
    """Python's integers, which have no bound."""
    return np.array([int(x) for x in values.ravel()] + [None], object)[:-1].reshape(values.shape)


def _survivors(q: np.ndarray, v: np.ndarray, q_length: np.ndarray, v_length: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Vectors that may reach some query's bound; rounding is allowed for."""
    if not (np.isfinite(q_length).all() and np.isfinite(v_length).all()):
        return np.ones(len(v), bool)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        cosine = bound / (q_length * v_length.max())
    cosine[~np.isfinite(cosine)] = -1.0
    keep = np.zeros(len(v), bool)
    unit = v / np.maximum(v_length, 1e-12)[:, None]
    for k in range(len(q)):
        t = min(cosine[k], 1.0) - 1e-9
        if t <= -1:
            return np.ones(len(v), bool)
        ok = v_length * q_length[k] >= bound[k] * (1 - 1e-9) - 1e-6 if bound[k] > 0 else np.ones(len(v), bool)
        if t >= COORDINATES_FROM:
            direction = q[k] / q_length[k]
            for f in np.argsort(-np.abs(direction))[:FOCUS]:
                middle = direction[f] * t
                reach = np.sqrt(max(0.0, (1 - t * t) * (1 - direction[f] ** 2)))
                ok &= (unit[:, f] >= (middle - reach if direction[f] < t else -1) - 1e-9) if direction[f] > -t else ok
                ok &= (unit[:, f] <= (middle + reach if direction[f] > -t else 1) + 1e-9) if direction[f] < t else ok
        keep |= ok
        if keep.all():
            break
    return keep


def _best(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q_keys, q = _matrix(b.column(0)[i].values)
                v_keys, v = _matrix(b.column(1)[i].values)
                bound = b.column(2)[i].as_py() or [None] * len(q)
                if not (np.isfinite(q).all() and np.isfinite(v).all()):
                    raise OverflowError("a component is beyond the range of a double after scaling")
                # sums below 2 to the 53 are exact in floating point, and quick; larger ones in longs, or else in Python's integers
                most = int(np.abs(q).max(initial=0)) * int(np.abs(v).max(initial=0)) * q.shape[1]
                kind = float if most < 2**53 else np.int64 if most < 2**63 else object
                floor = np.array([-np.inf if x is None else x for x in bound], float)
                with np.errstate(over="ignore"):
                    keep = np.flatnonzero(_survivors(q, v, np.sqrt((q**2).sum(1)), np.sqrt((v**2).sum(1)), floor))
                if not len(keep):
                    continue
                cast = _whole if kind is object else lambda x: x.astype(kind)
                score = cast(q) @ cast(v[keep]).T
                keys = v_keys[keep]
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for j in range(len(q)):
                    reached = np.ones(len(keys), bool) if bound[j] is None else np.asarray(score[j] >= bound[j], bool)
                    other = np.flatnonzero((keys != q_keys[j]) & reached)
                    if len(other) > k:
                        least = np.partition(score[j][other], len(other) - k)[len(other) - k]
                        other = other[np.asarray(score[j][other] >= least, bool)]
                    other = other[np.lexsort((keys[other], -score[j][other]))][:k]
                    best = score[j][other]
                    if kind is object:
                        if any(x >= 2**63 for x in best):
                            raise OverflowError(TOO_LARGE)
                        # other blocks may have better ones; null comes last
                        best = np.array([None if x < -2**63 else x for x in best], object)
                    else:
                        best = best.astype(np.int64)
                    out.append((np.full(len(other), q_keys[j]), keys[other], best))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[n] for o in out]), pa.int64()) for n in range(3)], ["query", "key", "score"])
    return work


def top_k(rows: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """The ``k`` best other rows of each row that meets ``queries``: query_id, rank, vec_id, score."""
    prepare(rows.sparkSession)
    v = F.col(vector)
    usable = rows.filter(F.col(key).isNotNull() & _usable(v)).select(F.col(key).cast("long").alias("key"), integers(v, scale).alias("v"), queries.alias("asks"))
    usable = usable.dropDuplicates(["key", "v"]).withColumn("dim", F.size("v"))
    names = None
    if usable.groupBy("key").count().filter("count > 1").limit(1).count():
        # rows take the place of keys, in the same order
        usable = stage(usable.orderBy("key", "v").withColumn("row", F.monotonically_increasing_id()), "rows")
        names = usable.select("row", "key")
        usable = usable.drop("key").withColumnRenamed("row", "key")
    # squares of the largest doubles are not finite, so components are divided by the largest one first
    usable = usable.withColumn("size", F.greatest(F.array_max(F.transform("v", F.abs)), F.lit(1.0)))
    usable = usable.withColumn("length", F.least(F.col("size") * F.sqrt(F.aggregate(F.transform("v", lambda x: x / F.col("size")), F.lit(0.0), lambda s, x: s + x * x)), F.lit(1.7e308))).drop("size")
    usable = stage(usable.withColumn("bucket", F.floor(F.log(F.greatest("length", F.lit(1.0))) / F.log(F.lit(STEP)))), "vectors")
    blocks = stage(_packed(usable, ["dim", "bucket"], BLOCK), "vector-blocks")
    asked = stage(_packed(usable.filter("asks"), ["dim"], QUERY_BLOCK), "query-blocks")
    schema = "query long, key long, score long"
    q = asked.select("dim", F.col("number").alias("asked"), F.col("rows").alias("q"), F.col("longest").alias("q_longest"))

    # a block of the longest bucket of each dimension gives the bounds
    first = blocks.groupBy("dim").agg(F.max(F.struct("bucket", "number"))["number"].alias("number"))
    longest = blocks.join(first, ["dim", "number"]).select("dim", F.col("rows").alias("v"))
    none = F.lit(None).cast("array<long>").alias("bound")
    begun = stage(q.join(longest, "dim").select("q", "v", none).mapInArrow(_best(k), schema), "top-first")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    ranked = begun.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select(F.col("query").alias("its"), F.col("score").alias("bound"))
    # bounds in the order of the query block's rows
    each = asked.select("number", F.posexplode("rows").alias("at", "row")).select("number", "at", F.col("row.key").alias("its"))
    bounds = (each.join(ranked, "its", "left").groupBy("number")
              .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "bound"))), lambda x: x["bound"]).alias("bound"))
              # a query without a bound needs every block
              .withColumn("least", F.when(F.forall("bound", lambda x: x.isNotNull()), F.array_min("bound").cast("double")).otherwise(F.lit(float("-inf")))).withColumnRenamed("number", "asked"))
    heads = q.drop("q").join(bounds, "asked")
    others = blocks.join(first, ["dim", "number"], "left_anti").select("dim", "number", "longest")
    pairs = others.join(heads, "dim").filter(F.col("q_longest") * F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("least")).select("asked", "number")
    rest = (pairs.join(q.select("asked", "q"), "asked").join(bounds.select("asked", "bound"), "asked")
            .join(blocks.select("number", F.col("rows").alias("v")), "number")
            .select("q", "v", "bound").mapInArrow(_best(k), schema))
    found = begun.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    if names is not None:
        found = (found.join(names.select(F.col("row").alias("query"), F.col("key").alias("_query")), "query").drop("query").withColumnRenamed("_query", "query")
                 .withColumnRenamed("key", "row").join(names, "row"))
    return found.select(F.col("query").alias("query_id"), "rank", F.col("key").alias("vec_id"), F.coalesce("score", F.raise_error(F.lit(TOO_LARGE)).cast("long")).alias("score"))
