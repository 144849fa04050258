"""Committed order batches, event files, SQL functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kirana.functions import phone, sql_functions, text
from kirana.session import scratch_path
from kirana.sources import sinks as sk
from kirana.sources.events import event_stream


def batch(spark, n):
    orders = spark.createDataFrame([(f"ORD-{n}", 10.0)], "order_id string, total_amount double")
    items = spark.createDataFrame([(f"ORD-{n}", 1, 2), (f"ORD-{n}", 2, 1)], "order_id string, product_id long, quantity long")
    return orders, items


def counts(spark, path):
    return tuple(f.count() for f in sk.read_orders(spark, path))


def test_order_batches_are_written_once(spark, monkeypatch):
    path = scratch_path(spark, "orders-test")
    assert counts(spark, path) == (0, 0)
    assert sk.write_orders(*batch(spark, 1), path, "b1") and not sk.write_orders(*batch(spark, 1), path, "b1")
    assert counts(spark, path) == (1, 2)
    # an attempt that dies between its two writes shows nothing, and can be made again
    orders, items = batch(spark, 2)
    broken = orders.withColumn("total_amount", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        sk.write_orders(broken, items, path, "b2")
    assert counts(spark, path) == (1, 2)
    assert sk.write_orders(orders, items, path, "b2") and counts(spark, path) == (2, 4)
    assert sorted(r.batch_id for r in sk.read_orders(spark, path)[0].collect()) == ["b1", "b2"]
    for name in ("", "_b", "a/b"):
        with pytest.raises(ValueError):
            sk.write_orders(orders, items, path, name)


def test_event_stream_resumes(spark):
    path, out = scratch_path(spark, "event-test"), scratch_path(spark, "event-sink")
    good = '{"event": "%s", "call_sid": "C1", "call": 1, "event_id": %d, "ts": "2024-01-01T00:00:0%dZ", "value": 1.5, "more": [1]}'
    lines = [[good % ("start", 1, 1), "no json"], [good % ("media", 2, 2), "[1]", ""], [good % ("stop", 3, 3), '{"call": 1}']]
    fail = [True]

    def write(b, n):
        b.write.mode("overwrite").parquet(f"{out}/n={n}")
        if n == 1 and fail:
            fail.clear()
            raise RuntimeError("lost after writing, before the commit")

    def run():
        q = (event_stream(spark, path, 1).writeStream.foreachBatch(write).option("checkpointLocation", f"{out}-ckpt").trigger(availableNow=True).start())
        q.awaitTermination()

    for part in lines:
        spark.createDataFrame([(x,) for x in part], "value string").coalesce(1).write.mode("append").text(path)
    with pytest.raises(Exception, match="lost after writing"):
        run()
    run()
    got = [(r.kind, r.event_id, r.bad_line) for r in spark.read.parquet(out).collect()]
    assert sorted(g[1] for g in got if g[0]) == [1, 2, 3] and {g[0] for g in got} == {"start", "media", "stop", None}
    assert sorted(g[2] for g in got if not g[0]) == ["", "[1]", "no json", '{"call": 1}']


def test_sql_functions_equal_the_columns(spark):
    sql_functions.register_functions(spark)
    rows = [(x,) for x in ("+91 98765-43210", "09876543210", "12", "", None, "hello", "Hello?!", "ok.", "aaaaaaa", " a ", "ಹಾಲು 2", "x" * 50, "hi hi")]
    t = spark.createDataFrame(rows, "t string")
    pairs = {"kirana_normalize_phone": phone.normalize_phone, "kirana_is_repetitive": text.is_repetitive, "kirana_greeting_intent": text.greeting_intent,
             "kirana_order_ref": text.order_ref}
    got = t.select(*[F.expr(f"{n}(t)").alias(f"a_{n}") for n in pairs], *[f(F.col("t")).alias(f"b_{n}") for n, f in pairs.items()], "t",
                   F.expr("kirana_has_kannada(t)").alias("k"))
    for r in got.collect():
        for n in pairs:
            assert r[f"a_{n}"] == r[f"b_{n}"], (n, r.t)
        assert r.k == (None if r.t is None else "ಹ" in r.t)
