"""Work that must not grow faster than the input."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from kirana.operators import ledger as lg
from kirana.operators import scan


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keys_of_few_rows_are_windowed_without_a_summary(spark):
    df = spark.range(2000).selectExpr("id % 50 AS k", "timestamp_seconds(id * 7200) AS ts", "id AS n", "id % 7 AS v")
    out = scan.running(df, ["k"], scan.time_bucket(F.col("ts")), [F.col("ts")], {"s": ("sum", F.col("v"))})
    assert "Join" not in _plan(out) and "Aggregate" not in _plan(out)
    out = scan.running_floor_balance(df, ["k"], scan.time_bucket(F.col("ts")), [F.col("ts")], F.lit(3), F.col("v"))
    assert "Join" not in _plan(out) and "Aggregate" not in _plan(out)


def test_keys_of_many_rows_are_split_and_equal_one_window(spark, monkeypatch):
    monkeypatch.setattr(scan, "SPLIT_ROWS", 20)
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 1, 1, 2, 2, 3 + n]), n * 3600, n, rng.choice([None, -4, 2, 5])) for n in range(400)]
    df = spark.createDataFrame(rows, "k long, t long, n long, v long").withColumn("ts", F.timestamp_seconds("t"))
    w = Window.partitionBy("k").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    agg = {"s": F.coalesce(F.sum("v").over(w), F.lit(0)), "l": F.last("v", True).over(w), "m": F.min("v").over(w)}
    want = sorted(map(tuple, df.select("n", *[c.alias(k) for k, c in agg.items()]).collect()))
    out = scan.running(df, ["k"], scan.time_bucket(F.col("ts")), [F.col("n")], {"s": ("sum", F.col("v")), "l": ("last", F.col("v")), "m": ("min", F.col("v"))})
    assert "Join" in _plan(out) and set(out.columns) == {*df.columns, *agg}
    assert sorted(map(tuple, out.select("n", *agg).collect())) == want
    d = F.coalesce(F.col("v"), F.lit(0))
    bal = scan.running_floor_balance(df, ["k"], scan.time_bucket(F.col("ts")), [F.col("n")], F.lit(6), d, floors=F.col("n") % 3 > 0)
    left, got = {}, {r.n: r.balance for r in bal.collect()}
    for k, _, n, v in rows:
        b = left.get(k, 6) + (v or 0)
        left[k] = max(0, b) if n % 3 else b
        assert got[n] == left[k]


def test_stock_moves_of_status_changes_carry_one_number_of_the_order(spark):
    t = spark.createDataFrame([("ORD-1", 1, 0, "CANCELLED", "CONFIRMED", "changed", "long")], "order_id string, ts long, step long, new_status string, previous_status string, outcome string, seq string")
    items = spark.createDataFrame([("ORD-1", 7, 2)], "order_id string, product_id long, quantity long")
    moves = lg.status_stock_moves(t, items)
    assert "seq" not in moves.columns and moves.select("step", "delta").collect() == [(0, 2)]


def test_keyed_rules_take_keys_in_groups_and_keep_nulls(spark):
    from kirana.streaming import ops
    from kirana.streaming.keyed import GROUPS, in_order, run_keyed
    from kirana.streaming.replay import read_replay, replay_files

    day = F.lit("2024-01-01").cast("timestamp")
    rows = [(None if n % 5 == 4 else n % 5, n, n // 3, None if n % 4 == 0 else float("nan") if n % 4 == 1 else n / 2) for n in range(60)]
    df = spark.createDataFrame(rows, "call long, event_id long, h long, energy double").withColumn("ts", day + F.make_dt_interval(F.lit(0), F.col("h").cast("int"))).drop("h")
    root, schema = replay_files(df, "ts", 2, late_seconds=7200, parts=3)
    seen = in_order(read_replay(spark, root, schema, 3), "call", "ts", ["energy", "event_id"], [], lambda s, r: (((s or (0,))[0] + 1,), [(r["event_id"], (s or (0,))[0], r["energy"])]),
                    "event_id long, nth long, energy double")
    assert "_group" in seen._jdf.queryExecution().analyzed().toString() and GROUPS >= 1
    got = {(r.call, r.event_id): (r.nth, repr(r.energy)) for r in run_keyed(seen, "grouped")[0].collect()}
    want = {}
    for k in (0, 1, 2, 3, None):  # nulls first, not-a-number last, as Spark sorts
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[3] is not None, r[3] != r[3], r[3] if r[3] is not None and r[3] == r[3] else 0, r[1]))
        want |= {(k, r[1]): (n, repr(r[3])) for n, r in enumerate(mine)}
    assert got == want


def test_replay_files_do_not_grow_with_the_table(spark, monkeypatch):
    import glob

    import pyarrow.parquet as pq

    import kirana.plans.catalog  # noqa: F401  registers the twins first
    from kirana.plans import q_stream
    from kirana.streaming import ops, replay

    monkeypatch.setattr(replay, "PART_ROWS", 100)
    roots, files = [], replay.replay_files
    monkeypatch.setattr(q_stream, "replay_files", lambda *a, **k: roots.append(files(*a, **k)) or roots[-1])
    df = spark.range(2000).selectExpr("id % 9 AS call", "id AS event_id", "timestamp_seconds(id * 600) AS ts", "id * 1.5D AS energy", "id % 2 = 0 AS loud")
    out = replay.run_to_table(ops.stream_frame_windows(q_stream._stream(spark, df, "ts"), "6 hours", "1 hour"), "w")
    assert max(pq.read_metadata(f).num_rows for f in glob.glob(roots[0][0].removeprefix("file:") + "/*.parquet")) <= 200
    from kirana.operators import calls as cl
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, cl.frame_windows(df, "6 hours", "1 hour").select(out.columns).collect()))


def test_replays_join_by_shuffle_not_through_the_driver(spark):
    from kirana.operators import replay

    products = spark.createDataFrame([(1, "rice"), (2, "oil")], "id long, name string")
    changes = spark.createDataFrame([("add", None, "Oil", 1), ("delete", 2, None, 2), ("add", None, "Oil", 3)], "op string, pid long, name string, seq long")
    customers = spark.createDataFrame([(1, "+919876543210", "n", "a")], "id long, phone_number string, name string, address string")
    callers = spark.createDataFrame([("register", "9876543210", "m", "b", 1)], "op string, phone string, name string, address string, seq long")
    frames = [*replay.replay_product_changes(products, changes, ["seq"]), *replay.replay_customer_changes(customers, callers, ["seq"])]
    assert [r.reason for r in frames[0].orderBy("seq").collect()] == ["already exists", "ok", "ok"]
    for frame in frames:
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()


def test_allocation_drops_settled_lines_and_is_right_where_keys_are_split(spark, monkeypatch):
    from tests.test_golden import _sequential_allocation

    rng = random.Random(4)
    orders = [f"o{i:03d}" for i in range(50)]
    lines = [(o, rng.randint(1, 4), rng.randint(1, 6)) for o in orders for _ in range(rng.randint(1, 3))]
    stock = {p: rng.randint(5, 40) for p in range(1, 5)}
    o = spark.createDataFrame([(oid, i) for i, oid in enumerate(orders)], "order_id string, id long")
    li = spark.createDataFrame(lines, "order_id string, product_id long, quantity long")
    st = spark.createDataFrame(list(stock.items()), "product_id long, stock long")
    kept, write = [], lg.written
    monkeypatch.setattr(lg, "written", lambda df, name: kept.append((name, df.columns)) or write(df, name))
    for most in (1 << 16, 2):
        monkeypatch.setattr(scan, "SPLIT_ROWS", most)
        monkeypatch.setattr(lg, "SPLIT_ROWS", most)
        got = {r.order_id: r.accepted for r in lg.allocate_orders(o, li, st, ("id",), 4).collect()}
        assert got == _sequential_allocation(orders, lines, stock)
    assert all("order_id" not in columns and "taken" not in columns for name, columns in kept if name == "allocate-lines")
