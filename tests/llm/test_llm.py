"""Operators of the training-data subpackage against brute force, on small
hand-made tables with nulls, blanks, ties, repeated rows, long texts and clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kirana.llm import toxicity
from kirana.llm.bpe_codec import encode_decode
from kirana.llm.clauses import DENIED, INSULTED, INSULTED_TARGET, REPORTED, THREAT, Grammar
from kirana.llm.components import components
from kirana.llm.exact_dedup import exact_groups
from kirana.llm.minhash import near_groups
from kirana.llm.mixing import mix
from kirana.llm.queries import ORACLE_SQL, QUERIES, tokenizer_file
from kirana.llm.suffix_dedup import without_repeats
from kirana.llm.token_counts import token_counts
from kirana.llm.topk import top_k

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, source string, size long, bucket string, key string, n long"


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choices("abcdeo", k=r.randint(1, 7))) for _ in range(n)]


def cases() -> list[tuple]:
    base = words(1, 400)
    near = base[:]
    near[100:104] = words(2, 4)
    far = base[:200] + words(3, 200)
    passage = " ".join(words(4, 60))
    texts = {
        1: " ".join(base), 2: " ".join(near), 3: " ".join(far), 4: "  ".join(base), 5: " ".join(base).upper(),
        6: None, 7: "", 8: " \n\t ", 9: "one two", 10: "one  two", 11: "ONE two", 12: "one",
        13: passage + " " + " ".join(words(5, 30)), 14: " ".join(words(6, 30)) + " " + passage, 15: "ab" * 400, 16: "Ha " * 300,
        17: " ".join(words(7, 20_000)), 18: "Straße ½ naïve <|endoftext|> İΣας 　日本語 é it's 1234 \x1c_x__\r\n\r\n  end ",
        19: "a\n b  c\n\nd <|endof <|startoftext|>x", 20: passage,
    }
    rows = [(k, t, f"s{k % 5}" if k % 7 else None, 5, "x", "y", 1) for k, t in texts.items()]
    return rows + [rows[8]] + [(None, "one two", "s1", 0, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases(), COLUMNS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def lean(t):
    return re.sub("[\x20\x09-\x0d]", "", t or "")


def test_exact_groups(docs, empty):
    got = [r.asDict() for r in exact_groups(docs).collect()]
    rows = cases()
    assert len(got) == len(rows)
    for r in got:
        same = [x for x in rows if hashlib.sha256(lean(x[1]).encode()).hexdigest() == r["text_sha256"]]
        best = max(same, key=lambda x: (len(x[1] or ""), x[0] is not None, -(x[0] or 0)))
        assert r["group_size"] == len(same) and r["keep_id"] == best[0] and r["kept"] == (r["doc_id"] == best[0])
    assert exact_groups(empty).count() == 0


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()


def brute_groups(rows):
    sets = {k: shingle_set(t) for k, t, *_ in rows if k is not None}
    root = {k: k for k in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[a] = root[b] = min(root[a], root[b])
    return sets, root


def test_near_groups(docs, empty):
    sets, root = brute_groups(cases())
    got = near_groups(docs).collect()
    assert len(got) == len(cases())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id)
    assert near_groups(empty).count() == 0


def test_near_groups_in_large_buckets(spark):
    """Many variants of one text at similarities around the bound: buckets beyond the pairing size."""
    r, base, rows = random.Random(9), words(10, 120), []
    for k in range(300):
        w = base[:]
        for _ in range(r.randint(0, 7)):
            w[r.randrange(len(w))] = f"v{k}x{r.random()}"
        rows.append((k, " ".join(w), "s", 0, "", "", 0))
    _, root = brute_groups_fast(rows)
    got = {x.doc_id: x.component_id for x in near_groups(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == root


def brute_groups_fast(rows):
    sets = {k: shingle_set(t) for k, t, *_ in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if 100 * len(x & y) >= 75 * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return sets, {k: find(k) for k in sets}


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5)]
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: find(k) for a, b in links if a != b for k in (a, b)}


def test_bpe_round(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    want = sorted((k is None, k or 0, e := lib.encode(t or "", add_special_tokens=False).ids, lib.decode(e, skip_special_tokens=False)) for k, t, *_ in cases())
    got = sorted((r.doc_id is None, r.doc_id or 0, list(r.ids), r.decoded) for r in encode_decode(docs, path).collect())
    assert got == want
    assert encode_decode(empty, path).count() == 0


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    key = lambda k: (k is None, k or 0)
    want = sorted((key(k), len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for k, t, *_ in cases())
    assert sorted((key(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts(docs, path).collect()) == want
    assert token_counts(empty, path).count() == 0


def test_common_splitter_rules():
    """The fast path's character classes are those of the Unicode letters and numbers."""
    import regex

    from kirana.llm.split import BYTE_PIECE, RARE

    full = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    for c in map(chr, range(0x250)):
        if not RARE.search(c):
            t = f"a{c}b 1{c}{c} {c}"
            assert BYTE_PIECE.findall(t) == full.findall(t), repr(c)


def test_suffix_dedup(docs, empty):
    rows = sorted({(k, t) for k, t, *_ in cases() if k is not None}, key=lambda x: x[0])
    seen, want = set(), {}
    for k, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 99):
            if b[s:s + 100] in seen:
                gone[s:s + 100] = True
            seen.add(b[s:s + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[k] = (len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0]), kept)
    got = without_repeats(docs).collect()
    assert len(got) == len(cases())
    for r in got:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id], r.doc_id
        else:
            assert r.n_removed == 0
    assert without_repeats(empty).count() == 0


def test_suffix_dedup_of_a_repeated_id(spark):
    passage, a, b = (" ".join(words(k, 60)) for k in (4, 21, 22))
    rows = [(7, passage + a), (7, "x" + passage + b), (7, passage + a), (3, b), (None, passage)]
    order = sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], hashlib.sha256(r[1].encode()).hexdigest()))
    seen, want = set(), {}
    for k, t in order:
        raw, gone = t.encode(), np.zeros(len(t.encode()), bool)
        for s in range(len(raw) - 99):
            if raw[s:s + 100] in seen:
                gone[s:s + 100] = True
            seen.add(raw[s:s + 100])
        want[k, t] = bytes(x for x, g in zip(raw, gone) if not g)
    got = without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), bytes(r.kept)) for r in got) == sorted((str(k), want.get((k, t), t.encode())) for k, t in rows)
    assert sum(len(t) for _, t in rows) > sum(len(r.kept) for r in got)


def test_pre_tokens_of_odd_texts():
    """Boundaries over bytes against the library, on short texts of awkward characters."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from kirana.llm.bpe import ranks
    from kirana.llm.pretokens import Frequencies
    from kirana.llm.split import splitter

    path = tokenizer_file("byte_bpe_50k.json")
    r = random.Random(5)
    letters = [*"ab'sS stredvlm  \n\t 1²é_-.\"…€ \u0085|<", "'re", "'ll", "<|endoftext|>", "日本", "\u3000", "'s"]
    texts = ["".join(r.choices(letters, k=r.randint(0, 14))) for _ in range(20_000)] + ["", None, "it's we're 'tis don't'll \n's  's", "-" * 5000]
    got = []
    for a, z, begin, which, times, pieces, special in Frequencies(splitter(path)).of(pa.array(texts, pa.string())):
        n = ranks(path).counts([p.encode() for p in pieces])[which] * times
        got += [int(n[begin[k]:begin[k + 1]].sum() + special[k]) for k in range(z - a)]
    assert got == [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_counts_in_small_blocks(spark, monkeypatch):
    from tokenizers import Tokenizer

    from kirana.llm import token_counts as tc

    for name, value in (("BLOCK_BYTES", 2000), ("BLOCK_PIECES", 30), ("ROW_PIECES", 4)):
        monkeypatch.setattr(tc, name, value)
    rule = "=" * 300
    rows = [(k, f"{rule} the cat {k} {rule}\nits {'x' * k}") for k in range(400)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tokenizer_file("byte_bpe_50k.json")).collect()
    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    assert sorted(tuple(r) for r in got) == [(k, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for k, t in rows]


def test_bpe_table_follows_the_merges(tmp_path):
    """A file with more merges than a fixed table would hold."""
    import json

    from kirana.llm.bpe import Ranks, byte_letters

    letters = byte_letters()
    vocab = {c: k for k, c in enumerate(letters)}
    merges = [[a, b] for a in letters for b in letters]
    merges += [[a + b, c] for a in letters[:64] for b in letters[:64] for c in letters[:60]]
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    path = tmp_path / "many.json"
    path.write_text(json.dumps({"model": {"vocab": vocab, "merges": merges, "end_of_word_suffix": None}, "added_tokens": []}))
    ranks = Ranks(str(path))
    assert len(merges) > 300_000
    ids = ranks.encode([b"!!!", b"ab"])
    assert [[ranks.tokens[i] for i in x] for x in ids] == [["!!!"], ["ab"]]


def test_mix(docs, empty, spark):
    mixed, plan = mix(docs, block_words=16)
    got = [r.asDict() for r in mixed.collect()]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(k), size(t)) for k, t, *_ in cases())
    assert all(0 <= r["taken"] <= 3 * r["size"] and (r["taken"] > 0) == (r["n_slots"] > 0) for r in got)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        taken = sum(r["taken"] for r in own)
        assert abs(taken - own[0]["target"]) <= 16 and own[0]["target"] <= 3 * own[0]["source_size"] and taken == own[0]["source_take"]
    pieces = plan.groupBy("place", "block").agg(F.sum("words").alias("n"), F.countDistinct("slot").alias("s")).collect()
    assert all(p.s == 1 for p in pieces)
    assert sorted(map(str, got)) == sorted(str(r.asDict()) for r in mix(docs, block_words=16)[0].collect())
    assert mix(empty)[0].count() == 0


def test_mix_follows_its_schedule(spark):
    """Another sequence of points takes other words; every source's words are those of its slots."""
    rows = [(k, "w " * (k % 97 + 3), "abc"[k % 3]) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = {}
    for name, point in (("corput", None), ("low", lambda t: (t % 10) / 40.0)):
        mixed, plan = mix(docs, block_words=64, slots=1, **({"point": point} if point else {}))
        taken = {r.source: (r.t, r.target) for r in mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("target")).collect()}
        slots = {r.place: r.n for r in plan.groupBy("place").agg(F.countDistinct("slot").alias("n")).collect()}
        assert all(min(64 * slots[place], 3 * sum(len(t.split()) for _, t, s in rows if s == source)) == taken[source][0] for place, source in enumerate("abc"))
        by[name] = taken
    assert by["corput"] != by["low"]
    assert all(abs(t - target) <= 3 * 64 for t, target in by["corput"].values())


def test_mix_sql_on_repeated_rows(spark):
    import duckdb

    rows = [(k // 2, t, f"s{k % 3}" if k % 5 else None) for k, t in enumerate([" ".join(words(k, k % 40)) for k in range(60)])] * 2 + [(None, "a b", "s1"), (3, None, "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in mix(docs)[0].select("doc_id", "size", "source_size", "target", "taken").collect()]
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert sorted(map(str, got)) == sorted(map(str, con.execute(ORACLE_SQL["op7_mix"]).fetchall()))


def test_top_k_of_a_repeated_key(spark):
    r = random.Random(4)
    rows = [(k // 2, [r.uniform(-1, 1) for _ in range(6)]) for k in range(60)]
    got = top_k(spark.createDataFrame(rows + rows[:5], "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, k=4).collect()
    whole = [(k, [int(np.floor(1024 * x)) for x in v]) for k, v in rows]
    want = []
    for i, (k, q) in enumerate(whole):
        if k % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), c, v) for j, (c, v) in enumerate(whole) if j != i)[:4]
            want += [(k, n + 1, c, -s) for n, (s, c, _) in enumerate(best)]
    assert sorted(tuple(x) for x in got) == sorted(want)


def test_grammar():
    g = Grammar({"dolt$": 5.0, "knav": 4.0})
    kinds = lambda t: [k for k, _ in g.clauses(t)[0]]
    assert kinds("What a dolt.") == [INSULTED]
    assert kinds("You are a dolt.") == [INSULTED_TARGET]
    assert kinds("He is not a dolt.") == [DENIED]
    assert kinds("Reported: nothing. The paper quoted a knavish word.") == [REPORTED]
    assert kinds("Soon I will hurt them.") == [THREAT]
    assert kinds("No dolts here, doltish.") == []
    assert g.clauses("") == ([], 0)


def test_grammar_of_targets_wraps_and_apostrophes():
    g = Grammar({"dolt$": 5.0})
    kinds = lambda t: [k for k, _ in g.clauses(t)[0]]
    assert kinds("He isn't a dolt.") == kinds("You don't look a dolt") == kinds("they aren’t dolt") == [DENIED]
    assert kinds("I'll kill you") == kinds("I will\nkill you.") == kinds("ich werde dich töten") == kinds("te voy a matar") == [THREAT]
    assert kinds("We will beat the record and shoot a film.") == kinds("I will kill.\n\nYou came.") == []
    assert kinds("He said he will hurt them.") == [REPORTED] and kinds("I will not hurt them.") == [DENIED]
    assert kinds("you\nare a\ndolt") == [INSULTED_TARGET]


def test_grammar_against_its_parts():
    """The product automaton against its transducers run one by one, without the jumps over other words."""
    from kirana.llm import clauses as cl

    r = random.Random(8)
    bag = ["dolt", "oak", "oak", "tree", "you", "him", "not", "said", "will", "kill", "werde", "isn't", ".", "\n", "\n\n"]
    g = Grammar({"dolt$": 5.0})
    for _ in range(3000):
        text = " ".join(r.choices(bag, k=r.randint(1, 14)))
        states, want = [first for _, first in cl.PARTS], []
        for word in cl.TOKEN.findall(text):
            kind = cl.INSULT if word == "dolt" else cl.NEGATION if word.endswith("n't") else cl.CLASS_OF.get(word, cl.OTHER if word.isalpha() else cl.BREAK)
            got = cl._clause(tuple(states), kind)
            want += [got] if got is not None else []
            states = [part(s, kind) for (part, _), s in zip(cl.PARTS, states)]
            if kind == cl.HARM and got is not None:
                states[-1] = (states[-1][0], 0)
        assert [k for k, _ in g.clauses(text)[0]] == want, text


def test_toxicity_learns(spark):
    r, rows, marks = random.Random(5), [], []
    for k in range(400):
        w, bad = words(1000 + k, 40), k % 5 == 0
        if bad:
            for _ in range(3):
                w.insert(r.randrange(len(w)), "zorg" + r.choice(["a", "ust", "en"]))
        rows.append((k, " ".join(w), "s", 0, "", "", 0))
        marks.append((k, int(bad), 1))
    docs = spark.createDataFrame(rows + [(None, None, None, 0, "", "", 0), (1000, "", None, 0, "", "", 0)], COLUMNS)
    labels = spark.createDataFrame(marks + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, text int")
    model = toxicity.fit(docs, labels.drop("text"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 402 and all(0 <= x.score <= 1 for x in got)
    held = [x for x in got if x.doc_id is not None and x.doc_id < 400 and x.held_out]
    assert held and all(x.predicted == (x.doc_id % 5 == 0) for x in held)
    assert not [x for x in got if x.doc_id in (None, 1000) and x.predicted]
    assert toxicity.without_toxic(docs, model).columns == docs.columns
    blank = toxicity.fit(docs, labels.drop("text").limit(0))
    assert toxicity.score(docs, blank).count() == 402


def test_toxicity_keeps_texts_that_share_a_passage(spark, monkeypatch):
    passage = " ".join(words(11, 40))
    rows = [(k, f"{passage} {' '.join(words(100 + k, 40))}") for k in range(300)] + [(k, passage) for k in range(300, 340)]
    rows += [(k, f" {passage.upper()}") for k in range(340, 380)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = []
    monkeypatch.setattr(toxicity, "stage", lambda df, name: kept.append([x.text for x in df.collect()]) or df)
    toxicity.fit(docs, docs.select("doc_id", F.lit(0).alias("toxic")))
    open_ = {t for k, t in docs.filter(~toxicity.held_out(F.col("doc_id"))).collect()}
    assert len(kept[0]) == len(set(kept[0])) and {" ".join(t.lower().split()) for t in kept[0]} == {" ".join(t.lower().split()) for t in open_}
    assert len(kept[0]) == len({t.lower().strip() for t in open_})


def test_top_k(spark):
    r = random.Random(8)
    rows = [(k, [r.uniform(-2, 2) * (1 + k % 3) for _ in range(6)], 0) for k in range(300)] + [(k, [1.0, 0.5], 0) for k in range(300, 312)]
    rows += [(400, None, 0), (401, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (402, [float("nan")] * 6, 0), (403, [float("inf")] * 6, 0), (404, [], 0), (None, [1.0] * 6, 0), rows[7]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    ints = {k: [int(np.floor(1024 * x)) for x in v] for k, v, _ in rows if k is not None and v and None not in v and np.isfinite(v).all()}
    want = []
    for q in [k for k in ints if k % 10 == 0]:
        best = sorted(((-sum(a * b for a, b in zip(ints[q], v)), k) for k, v in ints.items() if k != q and len(v) == len(ints[q])))[:10]
        want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(best)]
    got = [tuple(x) for x in top_k(frame, F.col("vec_id") % 10 == 0).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got) == sorted(want)
    assert top_k(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0


@pytest.mark.parametrize("size", [1e3, 20_000.0, 2e5, 1e6])
def test_top_k_of_long_vectors(spark, size):
    r = random.Random(9)
    rows = [(k, [size * r.uniform(-1, 1) for _ in range(6)]) for k in range(120)] + [(k, [size, -size, 0.5, 0.0, 0.0, 0.0]) for k in range(120, 140)]
    rows += [(k, [r.uniform(-1, 1) for _ in range(6)]) for k in range(140, 200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = {k: [int(np.floor(1024 * x)) for x in v] for k, v in rows}
    want = []
    for q in range(0, 200, 10):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v)), k) for k, v in ints.items() if k != q)[:10]
        want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(best)]
    got = [tuple(x) for x in top_k(frame, F.col("vec_id") % 10 == 0).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got) == sorted(want)


def test_top_k_beyond_a_long(spark):
    apart = spark.createDataFrame([(0, [1e200, 0.0]), (1, [0.0, 1.0]), (2, [-1e200, 1.0])], "vec_id long, embedding array<double>")
    assert [x.score for x in top_k(apart, F.col("vec_id") == 1).orderBy("rank").collect()] == [1 << 20, 0]
    more = apart.union(spark.createDataFrame([(k, [0.0, float(k)]) for k in range(3, 20)], apart.schema))
    assert [x.score for x in top_k(more, F.col("vec_id") == 0).collect()] == [0] * 10
    with pytest.raises(Exception, match="does not fit a long"):
        top_k(apart, F.col("vec_id") == 0).collect()


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_oracles(spark, key):
    from tests.oracle_compare import digest, duck

    c = duck(SF).execute(ORACLE_SQL[key])
    cols = [x[0] for x in c.description]
    got = QUERIES[key](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert digest(cols, [tuple(x) for x in got.select(*cols).collect()])[0] == digest(cols, c.fetchall())[0]


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage's rows from those of the stage before."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = [docs.collect()]
    for name, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        made.append(docs.collect())
    whole, clean, once, apart, mixed, coded = made
    assert {r.doc_id for r in clean} <= {r.doc_id for r in whole}
    by_text = {}
    for r in clean:
        by_text.setdefault(lean(r.text), []).append((-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in once) == sorted(min(v)[1] for v in by_text.values())
    _, root = brute_groups_fast([(r.doc_id, r.text) for r in once])
    assert sorted(r.doc_id for r in apart) == sorted(k for k, v in root.items() if k == v)
    times = {k: len(list(g)) for k, g in itertools.groupby(sorted(r.doc_id for r in mixed))}
    assert set(times) <= {r.doc_id for r in apart} and max(times.values()) <= 3
    assert sorted(r.doc_id for r in coded) == sorted(r.doc_id for r in mixed)
    assert [f.name for f in spark.read.parquet(f"{tmp_path}/mixing").schema] == ["doc_id", "text", "lang", "source", "n_chars"]
