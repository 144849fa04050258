"""Ranking against brute force on a catalog of many products per name, the
allocation certificate on wrong decisions, the forward as-of, and ordered histories."""

import datetime as dt
import random


from kirana.functions.lexicon import TEST_SYNONYMS, synonyms_frame
from kirana.operators import calls as cl
from kirana.operators import customers as cu
from kirana.operators import ledger as lg
from kirana.operators import search as se

DAY = dt.datetime(2024, 1, 1)


def test_search_ranks_like_brute_force(spark):
    rnd = random.Random(5)
    names = ["Red Rice", "red rice", "rice flour", "Brown rice", "oil", "Rice", "sun oil rice"]
    kinds = ["Grain", "grain", "Oil and fat", None]
    rows = [(k, rnd.choice(names), rnd.choice(kinds), rnd.randint(0, 2)) for k in range(300)]
    products = spark.createDataFrame(rows, "id long, name string, category string, stock_quantity long")
    asked = ["rice", "red rice", "  RICE ", "brown rice oil", "nothing here", "", "oil rice"]
    queries = spark.createDataFrame([(q, q) for q in asked], "qid string, query string")
    syn = synonyms_frame(spark, TEST_SYNONYMS)
    terms = {r.qid: (r.clean_q, r.terms) for r in se.expand_terms(queries, syn).collect()}
    for k in (1, 10):
        got = {}
        for r in se.search_catalog(queries, products, syn, k=k).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append((r.id, r.match))
        for q in asked:
            clean, words = terms[q]
            hits = [(0 if n.lower().startswith(clean) else 1 if clean in n.lower() else 2, n, i)
                    for i, n, c, s in rows if s > 0 and any(
                        t in n.lower() or (t in se.CATEGORY_WORDS and c and t in c.lower()) for t in words)]
            want = [(i, "match") for _, _, i in sorted(hits)[:k]]
            if not want:
                first = [i for i, _, _, s in rows if s > 0]
                want = [(i, "fallback") for i in first[:5]] if words else [(i, "default") for i in first[:10]]
            assert got[q] == want, q


def test_certificate_finds_wrong_decisions(spark):
    orders = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("none", 4)], "order_id string, id long")
    lines = spark.createDataFrame([("a", 1, 3), ("b", 1, 3), ("c", 1, 2)], "order_id string, product_id long, quantity long")
    stock = spark.createDataFrame([(1, 5)], "product_id long, stock long")
    right = {"a": True, "b": False, "c": True, "none": False}

    def proof(decisions):
        frame = spark.createDataFrame(list(decisions), "order_id string, accepted boolean")
        return lg.allocation_certificate(frame, orders, lines, stock, ("id",)).first()

    assert tuple(proof(right.items())) == (4, 1, 0, 0, 0)
    assert proof((right | {"b": True}).items()).n_mismatched == 2  # b does not fit, and then c does not either
    assert proof((right | {"c": False}).items()).n_mismatched == 1
    assert proof((right | {"none": True}).items()).n_mismatched == 1
    assert proof([x for x in right.items() if x[0] != "b"]).n_undecided == 1
    assert proof([*right.items(), ("a", True)]).n_repeated == 1
    made = lg.allocate_orders(orders, lines, stock, ("id",))
    assert tuple(lg.allocation_certificate(made, orders, lines, stock, ("id",)).first()) == (4, 1, 0, 0, 0)


def test_forward_asof(spark):
    b = "9000000001"
    calls = spark.createDataFrame([("c1", "+91" + b, DAY), ("c2", b, DAY + dt.timedelta(hours=5)), ("c3", "", DAY), ("c4", b, DAY + dt.timedelta(days=90))],
                                  "call_sid string, caller_phone string, started_at timestamp")
    at = [("o2", 1), ("o1", 1), ("o0", -1), ("o3", 5), ("o4", 24 * 80)]
    orders = spark.createDataFrame([(o, "0" + b, DAY + dt.timedelta(hours=h)) for o, h in at],
                                   "order_id string, customer_phone string, created_at timestamp")
    got = {r.call_sid: r.order_id for r in cl.asof_orders(calls, orders, forward=True).collect()}
    assert got == {"c1": "o1", "c2": "o3", "c3": None, "c4": None}
    got = {r.call_sid: r.order_id for r in cl.asof_orders(calls, orders, tolerance_seconds=1800, forward=True).collect()}
    assert got == {"c1": None, "c2": "o3", "c3": None, "c4": None}


def test_history_is_newest_first_with_lines(spark):
    customers = spark.createDataFrame([(1, "9000000001")], "id long, phone_number string")
    orders = spark.createDataFrame([(k, f"o{k}", "9000000001", 1.0, "CONFIRMED", DAY + dt.timedelta(days=d)) for k, d in ((1, 0), (2, 2), (3, 2))],
                                   "id long, order_id string, customer_phone string, total_amount double, status string, created_at timestamp")
    items = spark.createDataFrame([("o2", 7, 2, 1.5, 3.0), ("o2", 4, 1, 2.0, 2.0)],
                                  "order_id string, product_id long, quantity long, unit_price double, subtotal double")
    rows = cu.customer_order_history(customers, orders, items).collect()
    assert [r.order_id for r in rows] == ["o3", "o2", "o1"]
    assert [i.product_id for i in rows[1]["items"]] == [4, 7] and rows[0]["items"] == [] and rows[0].n_items == 0


def test_transcripts_in_blocks(spark):
    turns = spark.createDataFrame([(1, k, "user" if k % 2 else None, "hi" if k else None) for k in range(5)],
                                  "conv_id long, turn long, role string, text string")
    rows = cl.assemble_transcripts(turns, 2).orderBy("block").collect()
    assert "\n".join(r.text for r in rows).split("\n") == [": ", "user: hi", ": hi", "user: hi", ": hi"]
    assert [(r.n_turns, r.user_turns, r.assistant_turns) for r in rows] == [(2, 1, 0), (2, 1, 0), (1, 0, 0)]
