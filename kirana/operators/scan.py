"""Skew-safe running windows ("two-level scans").

A plain ``Window.partitionBy(key).orderBy(ts)`` puts every row of a key
into one task; if one call or product holds a third of the data, that
task is the whole job.  These helpers split each key of more than
``SPLIT_ROWS`` rows into buckets (a time grain by default), run the window
inside ``(key, bucket)``, and carry the state of earlier buckets in from a
per-bucket summary table (one row per such key and bucket, windowed over the
key).  All other keys are one window partition each, so that their rows are
shuffled once and need no summary.  The result equals the single-partition
window exactly; only the partitioning changes.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kirana.session import written

UNB = Window.unboundedPreceding

#: Rows of one key that a task may window at once.
SPLIT_ROWS = 1 << 16


def time_bucket(ts: Column, seconds: int = 86400) -> Column:
    """Bucket id for a timestamp: whole multiples of ``seconds`` since the epoch."""
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def _bucketed(df: DataFrame, by: list[str], bucket: Column) -> tuple[DataFrame, list[str], DataFrame | None]:
    """The rows with ``_bkt``, null but for keys of more than ``SPLIT_ROWS`` rows; the columns that
    partition the windows; and the rows of those keys, None where there are none.

    The keys are at most the rows by ``SPLIT_ROWS``, so their table may be broadcast."""
    many = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > SPLIT_ROWS)
    many, _ = written(many.select(*[F.col(k).alias(f"_m_{k}") for k in by]), "scan-keys")
    if not many.limit(1).count():
        return df, by, None
    cond = [F.col(k).eqNullSafe(F.col(f"_m_{k}")) for k in by]
    split = F.broadcast(many.withColumn("_split", F.lit(True)))
    d = df.withColumn("_bkt", bucket).join(split, cond, "left").drop(*[f"_m_{k}" for k in by])
    d = d.withColumn("_bkt", F.when(F.col("_split"), F.col("_bkt")))
    return d.drop("_split"), [*by, "_bkt"], d.filter("_split").drop("_split")


def running(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[Column],
            specs: dict[str, tuple[str, Column]], inclusive: bool = True, whole: bool = False) -> DataFrame:
    """Add running aggregates over ``order`` within ``by``.

    ``specs`` maps output name -> (kind, column) with kind one of
    ``sum``, ``count``, ``min``, ``max``, ``last`` (last non-null value).
    ``inclusive=False`` excludes the current row (frame ... to -1).
    ``order`` must be a total order within ``by`` and ``bucket`` must be
    non-decreasing along it.  ``whole`` says that no key has more than ``SPLIT_ROWS`` rows.
    """
    by = list(by)
    end = 0 if inclusive else -1
    values = {f"_v_{name}": col for name, (_, col) in specs.items()}
    d, parts, split = (df, by, None) if whole else _bucketed(df, by, bucket)
    d = d.withColumns(values)
    w_loc = Window.partitionBy(*parts).orderBy(*order).rowsBetween(UNB, end)
    summary_aggs, carry_cols, local_cols = [], [], []
    for name, (kind, _) in specs.items():
        v = f"_v_{name}"
        if kind in ("sum", "count"):
            x = F.col(v) if kind == "sum" else F.when(F.col(v).isNotNull(), F.lit(1)).otherwise(0)
            local_cols.append(F.sum(x).over(w_loc).alias(f"_l_{name}"))
            summary_aggs.append(F.sum(x).alias(f"_s_{name}"))
        elif kind == "min":
            local_cols.append(F.min(v).over(w_loc).alias(f"_l_{name}"))
            summary_aggs.append(F.min(v).alias(f"_s_{name}"))
        elif kind == "max":
            local_cols.append(F.max(v).over(w_loc).alias(f"_l_{name}"))
            summary_aggs.append(F.max(v).alias(f"_s_{name}"))
        elif kind == "last":
            local_cols.append(F.last(v, ignorenulls=True).over(w_loc).alias(f"_l_{name}"))
            summary_aggs.append(F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.col("_okey")))
                                .alias(f"_s_{name}"))
        else:
            raise ValueError(kind)
    local = d.select("*", *local_cols)
    if split is None:
        for name, (kind, _) in specs.items():
            lc = F.col(f"_l_{name}")
            local = local.withColumn(name, F.coalesce(lc, F.lit(0)) if kind in ("sum", "count") else lc)
        return local.drop(*[c for c in local.columns if c.startswith(("_v_", "_l_"))])
    split = split.withColumns({**values, "_okey": F.struct(*order)})
    summ = split.groupBy(*by, "_bkt").agg(*summary_aggs)
    w_b = Window.partitionBy(*by).orderBy("_bkt").rowsBetween(UNB, -1)
    for name, (kind, _) in specs.items():
        s = F.col(f"_s_{name}")
        agg = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}.get(kind)
        carry_cols.append((agg(s).over(w_b) if agg else F.last(s, ignorenulls=True).over(w_b))
                          .alias(f"_c_{name}"))
    carry = summ.select(*by, "_bkt", *carry_cols)
    out = _with_carry(local, carry, [*by, "_bkt"])
    for name, (kind, _) in specs.items():
        lc, cc = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind in ("sum", "count"):
            val = F.coalesce(cc, F.lit(0)) + F.coalesce(lc, F.lit(0))
        elif kind == "min":
            val = F.least(cc, lc)
        elif kind == "max":
            val = F.greatest(cc, lc)
        else:
            val = F.coalesce(lc, cc)
        out = out.withColumn(name, val)
    drop = ["_bkt"] + [c for c in out.columns if c.startswith(("_v_", "_l_", "_c_"))]
    return out.drop(*drop)


def _with_carry(local: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Join the state of earlier buckets; a null key or bucket is a value like any other."""
    other = carry.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    cond = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return local.join(other, cond, "left").drop(*[f"_k_{k}" for k in keys])


def running_floor_balance(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[Column],
                          opening: Column, delta: Column, out: str = "balance",
                          floors: Column | None = None) -> DataFrame:
    """Balance after each step of ``b = max(0, b + delta)`` starting at ``opening``.

    Where ``floors`` is given and false, a step just adds.  Closed form: with S
    the running sum of (opening + deltas), the floored balance is
    ``S - least(0, running min of S over the floored steps)``; a negative
    opening is not floored before the first of them.  Both running
    terms are computed with two-level scans: inside each bucket the local
    prefix sum ``s`` and its running minimum; across buckets the offset
    (sum of earlier bucket totals) and the minimum reached in earlier
    buckets.  ``opening`` must be constant within ``by``.
    """
    by = list(by)
    d, parts, split = _bucketed(df, by, bucket)
    w_loc = Window.partitionBy(*parts).orderBy(*order).rowsBetween(UNB, 0)
    floored = F.when(F.col("_floors"), F.col("_ls"))

    def local(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({"_d": delta.cast("bigint"), "_open": opening.cast("bigint"), "_floors": F.lit(True) if floors is None else floors})
        return rows.withColumn("_ls", F.sum("_d").over(w_loc)).withColumn("_lmin", F.min(floored).over(w_loc))

    d = local(d)
    if split is None:
        s_total = F.col("_open") + F.col("_ls")
        d = d.withColumn(out, s_total - F.least(F.lit(0), F.col("_open") + F.col("_lmin")))
        return d.drop("_floors", "_d", "_open", "_ls", "_lmin")
    summ = local(split).groupBy(*by, "_bkt").agg(F.sum("_d").alias("_tot"), F.min(floored).alias("_bmin"),
                                      F.first("_open").alias("_o"))
    w_b = Window.partitionBy(*by).orderBy("_bkt")
    prev = w_b.rowsBetween(UNB, -1)
    summ = summ.withColumn("_off", F.coalesce(F.sum("_tot").over(prev), F.lit(0)) + F.col("_o"))
    # minimum of S reached inside each earlier bucket = its offset + its local minimum
    summ = summ.withColumn("_cmin", F.min(F.col("_off") + F.col("_bmin")).over(prev))
    carry = summ.select(*by, "_bkt", "_off", "_cmin")
    j = _with_carry(d, carry, [*by, "_bkt"])
    off = F.coalesce("_off", "_open")
    s_total = off + F.col("_ls")
    m = F.least(F.col("_cmin"), off + F.col("_lmin"))
    j = j.withColumn(out, s_total - F.least(F.lit(0), m))
    return j.drop("_floors", "_bkt", "_d", "_open", "_ls", "_lmin", "_off", "_cmin")
