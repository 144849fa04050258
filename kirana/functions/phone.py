"""Phone number rules as Column expressions (JVM-side, codegen'd).

Each rule is a short regex chain with no repeated sub-expressions, so
whole-stage codegen stays small; composite rules that need the raw and
normalised forms several times are staged as separate projections
(``with_phone_keys``), which Catalyst keeps apart instead of inlining
the regex work several times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def py_strip(c: Column) -> Column:
    """Strip leading/trailing whitespace (Spark ``trim`` strips spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_phone(phone: Column) -> Column:
    """Digits only; 12 digits starting 91 -> last 10; 11 starting 0 -> last 10; NULL -> ''."""
    digits = F.regexp_replace(F.coalesce(phone, F.lit("")), r"[^\p{Nd}]", "")
    return F.regexp_replace(F.regexp_replace(digits, r"^91(\p{Nd}{10})$", "$1"), r"^0(\p{Nd}{10})$", "$1")


def canonical_phone(phone: Column) -> Column:
    """S2: '+91' + normalized when that is 10 digits, else the stripped raw value."""
    return F.when(F.length(normalize_phone(phone)) == 10,
                  F.concat(F.lit("+91"), normalize_phone(phone))).otherwise(py_strip(phone))


def _candidates(raw: Column, norm: Column) -> Column:
    has = norm != ""
    arr = F.array_distinct(F.array(
        raw, norm,
        F.when(has, F.concat(F.lit("+91"), norm)).otherwise(raw),
        F.when(has, F.concat(F.lit("0"), norm)).otherwise(raw)))
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit(None)).otherwise(arr)


def with_phone_keys(df: DataFrame, phone_col: str, prefix: str = "_ph") -> DataFrame:
    """Add ``{prefix}_raw`` (stripped) and ``{prefix}_norm`` (S1) columns in two projections."""
    return (df.withColumn(f"{prefix}_raw", py_strip(F.col(phone_col)))
            .withColumn(f"{prefix}_norm", normalize_phone(F.col(f"{prefix}_raw"))))


def with_phone_candidates(df: DataFrame, phone_col: str, out: str = "candidates") -> DataFrame:
    """S3 as a staged projection: ordered, de-duplicated [raw, norm, +91norm, 0norm]."""
    staged = with_phone_keys(df, phone_col, "_pc")
    return (staged.withColumn(out, _candidates(F.col("_pc_raw"), F.col("_pc_norm")))
            .drop("_pc_raw", "_pc_norm"))


def phone_candidates(phone: Column) -> Column:
    """S3 as a single Column (fine for one-off use; prefer ``with_phone_candidates``)."""
    return _candidates(py_strip(phone), normalize_phone(py_strip(phone)))


def with_history_candidates(df: DataFrame, stored_col: str, out: str = "candidates") -> DataFrame:
    """[stored, norm, +91norm] used to find a customer's orders."""
    staged = df.withColumn("_hc_norm", normalize_phone(F.col(stored_col)))
    n, s = F.col("_hc_norm"), F.col(stored_col)
    return (staged.withColumn(out, F.array_distinct(F.array(
        s, n, F.when(n != "", F.concat(F.lit("+91"), n)).otherwise(s)))).drop("_hc_norm"))
