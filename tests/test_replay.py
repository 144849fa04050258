"""Ordered change logs against one-by-one simulations."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from kirana.operators import replay
from kirana.operators.replay import replay_customer_changes, replay_product_changes

PRODUCTS = "id long, name string, category string, price double, unit string, stock_quantity long"
CHANGES = "seq long, op string, pid long, name string, category string, price double, unit string, stock_quantity long"


def catalog_by_hand(products, changes, used, unique):
    rows = {p[0]: p[1:] for p in products}
    top = max(rows, default=0)
    fresh, out = top, []
    for seq, op, pid, name, category, price, unit, stock in sorted(changes, key=lambda c: c[0]):
        name, category, unit = ((x or "").strip() for x in (name, category, unit))
        fresh += op == "add"
        if op not in ("add", "update", "delete"):
            reason = "unknown op"
        elif op != "delete" and not name:
            reason = "empty name"
        elif op != "delete" and price is not None and price < 0:
            reason = "negative price"
        elif op == "add" and any(r[0].lower() == name.lower() for r in rows.values()):
            reason = "already exists"
        elif op != "add" and pid not in rows:
            reason = "not found"
        elif op == "delete" and pid in used:
            reason = "used by an order"
        elif op == "update" and unique and name != rows[pid][0] and any(r[0] == name for r in rows.values()):
            reason = "name taken"
        else:
            reason = "ok"
            if op == "delete":
                del rows[pid]
            else:
                rows[fresh if op == "add" else pid] = (name, category or "Groceries", price, unit or "1 packet", 50 if stock is None and op == "add" else stock)
        out.append((seq, reason, (fresh if reason == "ok" else None) if op == "add" else pid))
    return out, sorted((k, *r) for k, r in rows.items())


def a_log(seed, n, names):
    r = random.Random(seed)
    out = []
    for k in range(n):
        op = r.choice(["add", "add", "update", "update", "delete", "delete", "delete", None] if k % 9 == 0 else ["add", "update", "delete"])
        name = r.choice([*names, *names, "", "  ", None])
        out.append((k, op, None if op == "add" else r.choice([None, *range(1, 14 + k // 4)]), name and r.choice([name, name.upper(), f" {name} "]),
                    r.choice(["", "Tea", None]), r.choice([1.5, -1.0, None, 2.0]), r.choice(["", "kg"]), r.choice([None, 3])))
    return out


@pytest.mark.parametrize("seed,unique", [(1, True), (3, False)])
def test_catalog(spark, monkeypatch, seed, unique):
    monkeypatch.setattr(replay, "RUN", 7)
    names = ["Milk", "milk", "Tea", "Rice", "Salt", "Dal"]
    products = [(k, f"p{k}" if unique else names[k % 3], "Tea", 1.0, "kg", 5) for k in range(1, 8)]
    log = a_log(seed, 150, names + ["p1", "p2", "p3"])
    used = {2, 9, 16}
    verdicts, table = replay_product_changes(spark.createDataFrame(products, PRODUCTS), spark.createDataFrame(log, CHANGES).repartition(3), ["seq"],
                                             spark.createDataFrame([(k,) for k in used] + [(None,)], "product_id long"), unique)
    want, rows = catalog_by_hand(products, log, used, unique)
    got = sorted((r.seq, r.reason, r.id) for r in verdicts.collect())
    assert got == want and verdicts.filter("accepted != (reason = 'ok')").count() == 0
    assert sorted(tuple(r) for r in table.collect()) == rows
    assert {r for _, r, _ in want} >= {"ok", "already exists", "not found", "used by an order"} and (not unique or "name taken" in {r for _, r, _ in want})


def test_catalog_examples(spark):
    products = spark.createDataFrame([(1, "Milk", "Dairy", 30.0, "1 l", 25)], PRODUCTS)
    log = [(1, "add", None, " milk ", "", 1.0, "", None), (2, "delete", 1, None, None, None, None, None), (3, "add", None, "milk", "", 1.0, "", None),
           (4, "update", 1, "Milk", "", 1.0, "", 5), (5, "update", 3, "Curd", "Dairy", 2.0, "1 kg", 35), (6, "add", None, "MILK", "Dairy", 9.0, "1 l", 8),
           (7, "delete", 3, None, None, None, None, None)]
    verdicts, table = replay_product_changes(products, spark.createDataFrame(log, CHANGES), ["seq"])
    assert [r.reason for r in verdicts.orderBy("seq").collect()] == ["already exists", "ok", "ok", "not found", "ok", "ok", "ok"]
    assert [tuple(r) for r in table.collect()] == [(4, "MILK", "Dairy", 9.0, "1 l", 8)]
    verdicts, table = replay_product_changes(products, spark.createDataFrame([], CHANGES), ["seq"])
    assert verdicts.count() == 0 and table.count() == 1
    verdicts, table = replay_product_changes(products.limit(0), spark.createDataFrame(log[:1], CHANGES), ["seq"])
    assert [tuple(r) for r in table.collect()] == [(1, "milk", "Groceries", 1.0, "1 packet", 50)]


def norm(p):
    d = re.sub(r"\D", "", p)
    return d[2:] if len(d) == 12 and d[:2] == "91" else d[1:] if len(d) == 11 and d[0] == "0" else d


def customers_by_hand(customers, changes):
    rows = {c[0]: list(c[1:]) for c in customers}
    fresh, out = max(rows, default=0) - 1, []
    for seq, op, cid, phone, name, address in sorted(changes, key=lambda c: c[0]):
        phone, name, address = ((x or "").strip() for x in (phone, name, address))
        n = norm(phone)
        canon = f"+91{n}" if len(n) == 10 else phone
        fresh += 2 * (op == "register")
        at = {r[0]: k for k, r in sorted(rows.items(), reverse=True)}
        found = next((at[p] for p in (phone, n, f"+91{n}" if n else phone, f"0{n}" if n else phone) if p in at), None) if phone else None
        target = None
        if op not in ("register", "update", "address", "delete"):
            reason = "unknown op"
        elif op in ("register", "update") and not name:
            reason = "empty name"
        elif op == "register" and not address:
            reason = "empty address"
        elif op != "delete" and not phone:
            reason = "empty phone"
        elif op in ("update", "delete") and cid not in rows or op == "address" and found is None:
            reason = "not found"
        elif op == "update" and at.get(canon, cid) != cid:
            reason = "phone taken"
        else:
            reason, target = "ok", cid
            if op == "register" and found is None:
                target = fresh
                rows[fresh] = [canon, name, address]
                if n and n != canon:
                    rows[fresh + 1] = [n, name, address]
            elif op == "register":
                target = found
                rows[found][1:] = [name, address]
            elif op == "address":
                target = found
                rows[found][2] = address
            elif op == "update":
                rows[cid] = [canon, name, address]
            else:
                del rows[cid]
        out.append((seq, reason, target))
    return out, sorted((k, *r) for k, r in rows.items())


CALLERS = "id long, phone_number string, name string, address string"
CALLER_CHANGES = "seq long, op string, cid long, phone string, name string, address string"


@pytest.mark.parametrize("seed", [1])
def test_customers(spark, monkeypatch, seed):
    monkeypatch.setattr(replay, "RUN", 7)
    r = random.Random(seed)
    tens = [f"98765432{k:02d}" for k in range(6)]
    forms = ["{}", "+91{}", "0{}", "91 {}", "+91 {} "]
    customers = [(k, forms[k % 3].format(t), f"n{k}", f"a{k}") for k, t in enumerate(tens[:4])]
    log = []
    for k in range(160):
        op = r.choice(["register", "register", "update", "update", "update", "address", "delete", "sell" if k % 10 == 0 else "delete"])
        phone = r.choice([r.choice(forms).format(r.choice(tens)), r.choice(forms).format(r.choice(tens)), "12-34", "", None] if k % 5 == 0 else [r.choice(forms).format(r.choice(tens))])
        log.append((k, op, r.choice([None, *range(8), *range(k, k + 8)]), phone, r.choice(["x", " y ", ""]), r.choice(["s", "t ", "", None])))
    verdicts, table = replay_customer_changes(spark.createDataFrame(customers, CALLERS), spark.createDataFrame(log, CALLER_CHANGES).repartition(3), ["seq"])
    want, rows = customers_by_hand(customers, log)
    assert sorted((v.seq, v.reason, v.id) for v in verdicts.collect()) == want
    assert sorted(tuple(t) for t in table.collect()) == rows
    assert {x for _, x, _ in want} >= {"ok", "not found", "phone taken", "empty name", "empty address", "unknown op"}


def test_delete_then_register_keeps_the_caller(spark):
    customers = spark.createDataFrame([(1, "9876543210", "A", "s")], CALLERS)
    log = [(1, "delete", 1, None, None, None), (2, "register", None, "+91 98765-43210", "B", "t"), (3, "register", None, "09876543210", "C", "u"), (4, "delete", 9, None, None, None)]
    verdicts, table = replay_customer_changes(customers, spark.createDataFrame(log, CALLER_CHANGES), ["seq"])
    assert sorted(tuple(t) for t in table.collect()) == [(2, "+919876543210", "B", "t"), (3, "9876543210", "C", "u")]
    assert [(v.reason, v.id) for v in verdicts.orderBy("seq").collect()] == [("ok", 1), ("ok", 2), ("ok", 3), ("not found", None)]
    assert replay_customer_changes(customers.limit(0), spark.createDataFrame([], CALLER_CHANGES), ["seq"])[1].count() == 0
