"""Tokenizer alignment, ranked search and chat formatting against brute force, and their edge cases."""

from __future__ import annotations

import bisect
import hashlib
import json
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kirana.llm import lexical
from kirana.llm.alignment import link_statistics
from kirana.llm.bpe import byte_letters
from kirana.llm.chat import LAYOUTS, fingerprints, formatted, read_back, turns_of_json, turns_of_rows
from kirana.llm.lexical import ranked_search
from kirana.llm.queries import HARD_TEXT, ORACLE_SQL, QUERIES, tokenizer_file
from tests.llm.test_llm import COLUMNS, SF, cases

A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    more = [(21, "x▁y z", "s", 1, "", "", 1), (22, " lead  two\ttab ", "s", 1, "", "", 1), (23, "<s>hi</s> <|endoftext|>", None, 1, "", "", 1),
            (24, "ünïcödé 東京 \U0001f600 end", "s", 1, "", "", 1), (25, "nul\x00l \x1f", "s", 1, "", "", 1)]
    return spark.createDataFrame(cases() + more, COLUMNS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def aligned_by_hand(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    library, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    library.encode_special_tokens = True
    back = {c: b for b, c in enumerate(byte_letters())}

    def piece(i):
        p = model.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    out, holds = [], defaultdict(int)
    for doc, text in rows:
        a = library.encode(" " + (text or ""), add_special_tokens=False)
        ids = a.ids, model.encode(text or "")
        raw = [[bytes(back[c] for c in t) if t != "<|endoftext|>" else t.encode() for t in a.tokens], [piece(i) for i in ids[1]]]
        if not text or any(b"".join(r) != (" " + text).encode() for r in raw):
            out.append((doc, 0, 0, 0, None, ""))
            continue
        spans = []
        for r in raw:
            ends = [0]
            for t in r:
                ends.append(ends[-1] + len(t))
            spans.append(list(zip(ends, ends[1:])))
        shared = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        member = [defaultdict(list), defaultdict(list)]
        for k in (0, 1):
            for i, (_, e) in zip(ids[k], spans[k]):
                member[k][bisect.bisect_left(shared, e)].append(str(i))
        groups = ["|".join(",".join(member[k][g]) for k in (0, 1)) for g in range(len(shared))]
        links, j = [], 0
        for (s, e), i in zip(spans[0], ids[0]):
            while j and spans[1][j - 1][1] > s:
                j -= 1
            while spans[1][j][1] <= s:
                j += 1
            while j < len(spans[1]) and spans[1][j][0] < e:
                links.append((i, ids[1][j]))
                j += 1
            j -= 1
        for p in set(links):
            holds[p] += 1
        out.append((doc, len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (i, _), n in holds.items():
        most[i] = max(most[i], n)
    return sorted((str(d), a, b, g, len(x or []), sum(holds[p] == most[p[0]] for p in x or []), sum(holds[p] for p in x or []), h)
                  for d, a, b, g, x, h in out)


def aligned_by_spark(docs):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((str(r[0]), *r[1:]) for r in link_statistics(docs, A, B).select(columns).collect())


def test_alignment_by_hand(docs, empty):
    assert aligned_by_spark(docs) == aligned_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    assert aligned_by_spark(empty) == []


def test_alignment_of_a_table_with_rare_pairs(spark, monkeypatch):
    from kirana.llm import alignment

    monkeypatch.setattr(alignment, "COMMON", 64)  # most pairs go through the shuffled join
    monkeypatch.setattr(alignment, "TABLE_IDS", 50)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert aligned_by_spark(docs) == aligned_by_hand([(r.doc_id, r.text) for r in docs.collect()])


def found_by_hand(docs, items, k=10):
    def cut(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    rows = [(d, Counter(cut(t))) for d, t in docs if cut(t)]
    n_docs, n_terms = len(rows), sum(c.total() for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    out = []
    for name, text in items:
        asked = Counter(cut(text))
        got = []
        for d, c in rows:
            m = 25 + 75 * c.total() * n_docs // n_terms
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t, n in asked.items() if c[t])
            got += [(-s, d is None, d or 0, d)] if s > 0 else []
        out += [(str(name), r + 1, str(g[3]), -g[0]) for r, g in enumerate(sorted(got)[:k])]
    return sorted(out)


ITEMS = [(1, "one two ONE Straße naïve"), (2, None), (3, ""), (4, " ".join(f"t{k}" for k in range(70)) + " ha one abc"), (None, "ha, it's!"),
         (6, "nowhere-found"), (7, "ab cd " * 500), (1, "two")]


def found_by_spark(docs, items, **more):
    return sorted((str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in ranked_search(docs, items, **more).collect())


def test_search_by_hand(spark, docs, empty, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(3)).withColumn("terms", F.lit(1))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = found_by_hand(rows, ITEMS)
    assert want and found_by_spark(docs, items) == want
    assert found_by_spark(docs, items, k=2) == found_by_hand(rows, ITEMS, 2)
    for name, value in (("BLOCK_DOCS", 4), ("STEP", 1), ("BLOCK_BYTES", 40)):
        monkeypatch.setattr(lexical, name, value)
    assert found_by_spark(docs.repartition(3), items) == want
    assert found_by_spark(empty, items) == [] and found_by_spark(docs, items.limit(0)) == [] and found_by_spark(docs, items.filter("text is null")) == []


def test_search_with_hundreds_of_terms(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(k, " ".join(t.split()[:400])) for k, t in rows[:12]] + [(-1, rows[3][1].lower())]
    assert found_by_spark(docs, spark.createDataFrame(items, "item_id long, text string")) == found_by_hand(rows, items)


@pytest.mark.parametrize("key", ["op12_search", "op13_chat"])
def test_against_duckdb(spark, key):
    from tests.oracle_compare import digest, duck

    got = QUERIES[key](spark, SF)
    want = duck(SF).execute(ORACLE_SQL[key])
    assert digest(got.columns, [tuple(r) for r in got.collect()])[0] == digest([c[0] for c in want.description], want.fetchall())[0]


def chats(frame):
    return [(r.conv_id, r.layout, [(t.role, t.text) for t in r.turns], r.learnt, r) for r in read_back(formatted(frame)).collect()]


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a ## # </turn>\n### User: \\n \\"), (1, 1, "assistant", "b"), (2, None, None, None), (2, 5, "system", None),
            (None, 0, "user", "x"), (None, 1, "tool: =x\\</", "y\nz"), (3, 0, "User", HARD_TEXT), (3, 1, "assistant", "#" * 5 + "\\#\\# </</" + HARD_TEXT * 3), (4, 0, "assistant", "w " * 100_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame = frame.withColumn("prompt", F.lit("p")).withColumn("id", F.lit("q")).withColumn("at", F.lit(1)).withColumn("a.b", F.lit(1))
    got = {c: (said, learnt, r) for c, layout, said, learnt, r in chats(turns_of_rows(frame)) if layout == "turn_rows"}
    assert got[1][0] == [("user", rows[1][3]), ("assistant", "b"), ("assistant", "b")] and got[1][1] == ["b", "b"]
    assert got[2][0] == [("system", ""), ("", "")] and got[2][1] == []
    assert got[None][0] == [("user", "x"), ("tool: =x\\</", "y\nz")]
    assert got[3][0] == [("User", HARD_TEXT), ("assistant", rows[8][3])] and got[4][1] == ["w " * 100_000]
    for said, learnt, r in got.values():
        assert r.formatted.count("</turn>") == len(said) == r.n_turns == len(r.loss)
        spans = [r.formatted[m.start:m.end] for m in r.loss if m]
        assert [re.sub(r"(?s)\\(.)", r"\1", s) for s in spans] == learnt
    assert chats(turns_of_rows(frame.limit(0))) == []


def test_chat_layouts(spark):
    says = [("user", "q"), ("assistant", "r")]
    records = [
        ({"id": 1, "messages": [{"role": "user", "content": "q"}, {"content": "r", "role": "assistant", "name": "n"}]}, "messages", says),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}, {"from": "tool", "value": None}]}, "from_value", says + [("tool", "")]),
        ({"instruction": "q", "output": "r", "input": ""}, "instruction", says),
        ({"instruction": "q", "output": "r", "input": "i", "system": "s"}, "instruction", [("system", "s"), ("user", "q\ni"), ("assistant", "r")]),
        ({"prompt": "q", "response": "r", "meta": {"prompt": {"response": [1, {"x": "y"}]}}, "we`ird: <k>": {}}, "prompt_response", says),
        ({"prompt": "q", "completion": "r", "response": None}, "prompt_response", [("user", "q"), ("assistant", "")]),
        ({"prompt": None, "completion": "r"}, "prompt_completion", [("user", ""), ("assistant", "r")]),
        ({"id": 1, "prompt": "q", "completion": "r"}, "prompt_completion", says),
        ({"messages": []}, None, []), ({"text": "q"}, None, []), ([1, 2], None, []), (7, None, []),
    ]
    lines = [json.dumps(r) for r, _, _ in records] + ["no json", None]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "n long, json string")
    got = chats(turns_of_json(frame))
    want = [(x, said) for _, x, said in records] + [(None, [])] * 2
    assert sorted((str(x), said) for _, x, said, _, _ in got) == sorted((str(x), said) for x, said in want)
    assert sorted(c for c, *_ in got if c is not None) == [1, 1]
    table = spark.createDataFrame([("q", "r", None, [("user", "u")]), (None, None, "r", [("assistant", None)]), ("q", None, "r", None)],
                                  "prompt string, response string, completion string, messages array<struct<role string, content string>>")
    assert sorted((str(x), said) for _, x, said, _, _ in chats(turns_of_rows(table))) == [
        ("messages", [("assistant", "")]), ("messages", [("user", "u")]), ("prompt_completion", says)]
    assert len(fingerprints(LAYOUTS)) == 4 + 2 + 2 + 8 + 4 + 4
