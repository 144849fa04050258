"""Change-set sinks over parquet tables (SNK1, SNK2, SNK4-SNK7).

Parquet has no MERGE, so each upsert is a declarative plan -- full outer
or anti joins plus ``coalesce`` -- that produces the new table version;
writing it is a plain ``overwrite``/``append`` of that DataFrame.  The
latest change per key is picked with an aggregate (``max_by``), never by
collecting a key's history into one place.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kirana.functions.phone import py_strip, with_phone_keys
from kirana.operators.customers import resolve_customers
from kirana.operators.replay import replay_customer_changes, replay_product_changes


def upsert_catalog(products: DataFrame, changes: DataFrame) -> DataFrame:
    """SNK1: changes matched on name overwrite category, price and unit and keep the
    existing stock; an unknown name is inserted with the stock of its first row (by
    ``seq``), as every later row finds it present, and the rest of its last row."""
    c = (changes.groupBy("name").agg(F.max_by(F.struct("category", "price", "unit"), "seq").alias("_c"),
                                     F.min_by(F.struct("stock_quantity"), "seq").alias("_f"))
         .select("name", F.col("_c.category").alias("c_category"), F.col("_c.price").alias("c_price"),
                 F.col("_c.unit").alias("c_unit"), F.col("_f.stock_quantity").alias("c_stock")))
    j = products.join(c, "name", "full_outer")
    return j.select(
        F.col("id"), "name",
        F.coalesce("c_category", "category").alias("category"),
        F.coalesce("c_price", "price").alias("price"),
        F.coalesce("c_unit", "unit").alias("unit"),
        F.when(F.col("id").isNotNull(), F.col("stock_quantity")).otherwise(F.col("c_stock")).alias("stock_quantity"))


def insert_if_absent(base: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """SNK2: add the rows whose key is new, ignore the rest; among several new rows
    for one key the first by ``order`` is inserted (``min_by``, map-side combined)."""
    cols = [c for c in rows.columns if c != key]
    new = (rows.join(base.select(key), key, "left_anti")
           .groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r"))
           .select(key, *[F.col(f"_r.{c}").alias(c) for c in cols]))
    return base.unionByName(new.select(*[c for c in new.columns if c in base.columns]), allowMissingColumns=True)


def evolve_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """SNK5: add missing nullable columns (typed NULLs), keep the data and order."""
    out = df
    for f in schema.fields:
        if f.name not in out.columns:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
    return out


def apply_customer_changes(customers: DataFrame, changes: DataFrame, order: list[str]) -> DataFrame:
    """SNK4: the customers after registrations, address changes, updates and deletes, one
    after the other (``replay_customer_changes`` also gives the verdict on each)."""
    return replay_customer_changes(customers, changes, order)[1]


def register_latest(customers: DataFrame, changes: DataFrame, order: list[str]) -> DataFrame:
    """Registrations alone, in one plan and by caller: each caller's latest one holds.

    A caller the table knows (J1) gets its name and address; otherwise the canonical
    phone and its 10-digit alias are inserted, both with the latest name and address.
    (One after the other, a later registration writes only the row its phone finds.)"""
    c = changes.filter((py_strip(F.col("name")) != "") & (py_strip(F.col("address")) != "") & (py_strip(F.col("phone")) != ""))
    r = resolve_customers(c.withColumn("_seq", F.struct(*order)), customers, "_seq", "phone")
    said = F.struct(py_strip(F.col("name")).alias("n"), py_strip(F.col("address")).alias("a"))
    upd = (r.filter(F.col("customer_id").isNotNull()).groupBy(F.col("customer_id").alias("id")).agg(F.max_by(said, "_seq").alias("_u")))
    kept = customers.join(upd, "id", "left").select(
        "id", "phone_number", F.coalesce("_u.n", "name").alias("name"), F.coalesce("_u.a", "address").alias("address"))
    fresh = with_phone_keys(r.filter(F.col("customer_id").isNull()), "phone", "_p")
    canon = F.when(F.length("_p_norm") == 10, F.concat(F.lit("+91"), F.col("_p_norm"))).otherwise(F.col("_p_raw"))
    fresh = (fresh.withColumn("_canon", canon).groupBy("_canon")
             .agg(F.max_by(F.struct(py_strip(F.col("name")).alias("n"), py_strip(F.col("address")).alias("a"),
                                    F.col("_p_norm").alias("norm")), "_seq").alias("_f")))
    aliases = F.array_distinct(F.filter(F.array(F.col("_canon"), F.col("_f.norm")), lambda x: x != ""))
    ins = fresh.select(F.lit(None).cast("bigint").alias("id"), F.explode(aliases).alias("phone_number"),
                       F.col("_f.n").alias("name"), F.col("_f.a").alias("address"))
    ins = ins.join(kept.select("phone_number"), "phone_number", "left_anti")
    return kept.unionByName(ins)


def apply_product_changes(products: DataFrame, changes: DataFrame, order: list[str]) -> DataFrame:
    """SNK7 against a catalog whose names may repeat: the changes with ``accepted`` and
    ``reason``.  Ids are those of the table; ``replay_product_changes`` also gives the
    catalog afterwards and lets later changes name the ids of earlier adds."""
    return replay_product_changes(products, changes, order, unique_names=False, new_ids=False)[0].drop("id")


def _fs(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and a maker of its path objects."""
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return new(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), new


def write_orders(accepted_orders: DataFrame, accepted_items: DataFrame, path: str, batch_id: str) -> bool:
    """SNK6: headers and lines of a batch, visible together or not at all, and once.

    The data go to a folder of this attempt; then one small file under ``commits``, named
    after the batch and holding the attempt's name, is renamed into place.  A batch that
    has such a file is not written again, so a retry changes nothing (False is returned);
    an attempt that dies before leaves a folder that no reader looks at."""
    if not re.fullmatch(r"[\w.=-]+", batch_id) or batch_id.startswith((".", "_")):
        raise ValueError(f"a batch id names a file: {batch_id!r}")
    spark = accepted_orders.sparkSession
    fs, new = _fs(spark, path)
    commit = new(f"{path}/commits/{batch_id}")
    if fs.exists(commit):
        return False
    attempt = f"{batch_id}-{uuid.uuid4().hex[:12]}"
    for name, rows in (("order_items", accepted_items), ("orders", accepted_orders)):
        rows.withColumn("batch_id", F.lit(batch_id)).write.parquet(f"{path}/attempts/{attempt}/{name}")
    draft = new(f"{path}/commits/_{attempt}")
    out = fs.create(draft, False)
    out.write(bytearray(attempt.encode()))
    out.close()
    if fs.exists(commit) or not fs.rename(draft, commit):  # another attempt was faster
        fs.delete(draft, False)
        fs.delete(new(f"{path}/attempts/{attempt}"), True)
        return False
    return True


#: What a reader gets where nothing is committed yet.
NO_ORDERS = "order_id string, batch_id string"


def read_orders(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SNK6 reader: headers and lines of the committed batches (one path for each)."""
    fs, new = _fs(spark, path)
    if not fs.exists(new(f"{path}/commits")) or not fs.listStatus(new(f"{path}/commits")):
        return spark.createDataFrame([], NO_ORDERS), spark.createDataFrame([], NO_ORDERS)
    done = [r.value for r in spark.read.text(f"{path}/commits").collect()]  # Spark skips drafts, whose names begin with _
    if not done:
        return spark.createDataFrame([], NO_ORDERS), spark.createDataFrame([], NO_ORDERS)
    return tuple(spark.read.option("mergeSchema", "true").parquet(*[f"{path}/attempts/{a}/{name}" for a in done]) for name in ("orders", "order_items"))
