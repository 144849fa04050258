"""Alignment of two tokenizers' ids (operator 11).

1. Every text is encoded whole by both libraries: space + text by a byte-level file of
   the tokenizers library (A), the text by a sentencepiece model (B).  The joined bytes
   of either must be those of space + text; else the text has no tokens.
2. A byte offset where tokens of both end and the next tokens of both begin with a space
   is an anchor; anchors cut a text into windows of token ids.  A window's alignment
   (groups and links) depends on its ids alone, so it is worked out once per pair of id
   tuples and kept in a bounded table.
3. Links are counted per document, the documents of each id pair are counted over the
   corpus, and the counts are joined back: pairs that make up one in ``COMMON`` of all
   (document, pair) rows or more, at most ``COMMON`` by definition, on the map side, the
   others by a shuffled join, in which no pair has more than that share.

Defined results: a null or empty text and one that a tokenizer doesn't give back have
zeros and an empty digest; every row is a document, so repeated rows count each and null
keys stay; an empty table returns no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kirana.llm.bpe import byte_letters
from kirana.llm.common import prepare, stage, texts, utf8
from kirana.llm.shingles import slices
from kirana.llm.split import RARE

COMMON = 1 << 20
#: Ids of the windows that a worker keeps; beyond it the table starts anew.
TABLE_IDS = 3_000_000
#: How byte-level files of this kind cut texts (fixed by the tokenizer).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteTokens:
    """Ids of a byte-level file, special tokens' strings being plain text.

    Where ids rise with merge ranks, texts of common characters go through tiktoken with
    the file's own vocabulary, which gives the same ids; all others through the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {c: b for b, c in enumerate(byte_letters())}
        vocab: dict[str, int] = spec["model"]["vocab"]
        special = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.bytes = [b""] * (max([*vocab.values(), *special]) + 1)
        for t, i in vocab.items():
            self.bytes[i] = special.get(i) or bytes(letters[c] for c in t)
        for i, t in special.items():
            self.bytes[i] = t
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        made = [vocab[a + b] for a, b in merges]
        cut = spec.get("pre_tokenizer") or {}
        plain = (spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space")
                 and cut.get("use_regex", True) and all(a < b for a, b in zip(made, made[1:]))
                 and min(made, default=0) > max(vocab[c] for c in letters))
        self.quick = None
        if plain:
            import tiktoken

            ranks = {self.bytes[i]: i for t, i in vocab.items() if i not in special}
            self.quick = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, batch: list[str]) -> list[list[int]]:
        rare = [k for k, t in enumerate(batch) if self.quick is None or RARE.search(t)]
        slow = dict(zip(rare, self.library.encode_batch([batch[k] for k in rare], add_special_tokens=False)))
        return [slow[k].ids if k in slow else self.quick.encode_ordinary(t) for k, t in enumerate(batch)]


class PieceTokens:
    """Ids of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in ((i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size()))]

    def encode(self, batch: list[str]) -> list[list[int]]:
        return self.model.encode(batch, num_threads=1)


def _spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (many[0] of them), first[1], ..."""
    ends = np.cumsum(many)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - many), many)


class Windows:
    """Alignments of windows, each worked out once and numbered; new ones are worked out together."""

    def __init__(self, a: ByteTokens, b: PieceTokens):
        self.length = [np.array([len(t) for t in x.bytes], np.int64) for x in (a, b)]
        self.many_b = len(b.bytes)
        digits = [str(i).encode() + b"," for i in range(max(len(a.bytes), len(b.bytes)))]
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.wide = np.array([len(d) for d in digits], np.int64)
        self.at = np.cumsum(self.wide) - self.wide
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.groups: list[str] = []
        self.n_groups = array("q")
        self.links = array("q")  # id pairs as a * many_b + b
        self.n_links = array("q")
        self.ids = 0

    def of(self, keys: list[bytes], ids: list[np.ndarray], first: list[np.ndarray], last: list[np.ndarray]) -> list[int]:
        """Numbers of windows: ids of A and B from ``first`` up to ``last``, and the bytes of both."""
        got = list(map(self.number.get, keys))
        new = []
        for k in [k for k, x in enumerate(got) if x is None]:
            n = got[k] = self.number.setdefault(keys[k], len(self.number))
            if n == len(self.groups) + len(new):
                new.append(k)
        if new:
            many = [z[new] - a[new] for a, z in zip(first, last)]
            self._align([x[_spread(a[new], n)].astype(np.int64) for x, a, n in zip(ids, first, many)], many)
        return got

    def _align(self, ids: list[np.ndarray], many: list[np.ndarray]) -> None:
        """Adds windows whose tokens stand one window after the other; both sides cover the same bytes."""
        end_a, end_b = (np.cumsum(n[x]) for n, x in zip(self.length, ids))
        stop = end_a[np.cumsum(many[0]) - 1]
        in_a = np.searchsorted(end_a, end_b)
        both = end_a[in_a] == end_b
        # every range between neighbouring ends of either side lies in one token of each: a link
        ends = np.sort(np.concatenate([end_a, end_b[~both]]))
        self.links.frombytes((ids[0][np.searchsorted(end_a, ends)] * self.many_b + ids[1][np.searchsorted(end_b, ends)]).tobytes())
        self.n_links.frombytes(np.diff(np.searchsorted(ends, stop, "right"), prepend=0).tobytes())
        shared = end_b[both]
        self.n_groups.frombytes(np.diff(np.searchsorted(shared, stop, "right"), prepend=0).tobytes())
        # the ids of a group's A tokens, then of its B tokens, each with the mark behind it
        group = [np.searchsorted(shared, e) for e in (end_a, end_b)]
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        token = np.concatenate(ids)[order]
        side = np.concatenate([2 * group[0], 2 * group[1] + 1])[order]
        wide = self.wide[token]
        text = self.digits[_spread(self.at[token], wide)]
        behind = np.cumsum(wide)
        closes = np.flatnonzero(np.diff(side, append=-1) != 0)
        text[behind[closes] - 1] = np.where(side[closes] % 2 == 0, ord("|"), ord(";"))
        cut = behind[np.cumsum(many[0] + many[1]) - 1].tolist()
        said = text.tobytes().decode("ascii")
        self.groups += [said[p:q - 1] for p, q in zip([0, *cut[:-1]], cut)]
        self.ids += len(token)


class Aligner:
    """Aligns batches of texts."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokens(path_a), PieceTokens(path_b)
        self.windows = Windows(self.a, self.b)
        self.length = self.windows.length
        self.spaced = [np.array([t.startswith(b" ") for t in x.bytes]) for x in (self.a, self.b)]

    def tokens(self, batch: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B; none where the bytes of either are not those of space + text.

        Without a normaliser, byte-level ids always give their text back, so A needs no test then."""
        full = [" " + t for t in batch]
        a, b = self.a.encode(full), self.b.encode(batch)
        table_a, table_b = self.a.bytes.__getitem__, self.b.bytes.__getitem__
        for k, t in enumerate(full):
            raw = t.encode()
            if not batch[k] or b"".join(map(table_b, b[k])) != raw or self.a.quick is None and b"".join(map(table_a, a[k])) != raw:
                a[k], b[k] = [], []
        return a, b

    def batch(self, batch: list[str]) -> dict[str, pa.Array]:
        """Counts, digest, and the distinct id pairs with their links for each text."""
        if self.windows.ids > TABLE_IDS:
            self.windows.clear()
        ids = self.tokens(batch)
        begin = [np.cumsum([0, *map(len, x)]) for x in ids]
        flat = [np.fromiter(chain.from_iterable(x), np.int32, count=int(n[-1])) for x, n in zip(ids, begin)]
        end = [np.cumsum(self.length[k][x]) for k, x in enumerate(flat)]
        # anchors: shared ends before space-marked tokens, and the end of each text
        at_b = np.searchsorted(end[1], end[0])
        shared = np.flatnonzero(end[1][at_b] == end[0]) if len(end[0]) else np.zeros(0, np.int64)
        opens = [np.append(self.spaced[k][x], True) for k, x in enumerate(flat)]
        last = np.zeros(len(flat[0]) + 1, bool)
        last[begin[0][1:]] = True
        cut_a = shared[(opens[0][shared + 1] & opens[1][at_b[shared] + 1]) | last[shared + 1]] + 1
        cut_b = at_b[cut_a - 1] + 1
        last_of = [cut_a, cut_b]
        first_of = [np.concatenate([[0], c])[:-1] for c in last_of]
        # a window's key: its ids of A, -1, its ids of B
        n_a, n_b = (z - a for a, z in zip(first_of, last_of))
        key_end = np.cumsum(n_a + 1 + n_b)
        begins = key_end - (n_a + 1 + n_b)
        said = np.full(int(key_end[-1]) if len(key_end) else 0, -1, np.int32)
        said[_spread(begins, n_a)], said[_spread(begins + n_a + 1, n_b)] = flat
        raw, stops = said.tobytes(), (4 * key_end).tolist()
        keys = [raw[p:q] for p, q in zip([0, *stops[:-1]], stops)]
        number = self.windows.of(keys, flat, first_of, last_of)
        window = np.array(number, np.int64)
        of_doc = np.searchsorted(cut_a, begin[0], "right")  # windows end where their document ends at the latest
        n_groups, many, links = (np.array(x, np.int64) for x in (self.windows.n_groups, self.windows.n_links, self.windows.links))
        ends = np.cumsum(many) - many

        def sums(x: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(x)])
            return total[of_doc[1:]] - total[of_doc[:-1]]

        text = self.windows.groups.__getitem__
        digest = [hashlib.sha256(";".join(map(text, number[p:q])).encode()).hexdigest() if p < q else ""
                  for p, q in zip(of_doc[:-1].tolist(), of_doc[1:].tolist())]
        doc = np.repeat(np.arange(len(batch)), np.diff(of_doc))
        own, often = np.unique(doc * max(1, len(many)) + window, return_counts=True)
        doc, window_of = np.divmod(own, max(1, len(many)))
        size = many[window_of] if len(many) else np.zeros(0, np.int64)
        where = _spread(ends[window_of], size) if len(many) else size
        span = len(self.a.bytes) * len(self.b.bytes)
        pair, back = np.unique(np.repeat(doc, size) * span + links[where], return_inverse=True)
        times = np.bincount(back, np.repeat(often, size), len(pair)).astype(np.int64)
        lists = pa.array(np.searchsorted(pair, np.arange(len(batch) + 1) * span).astype(np.int32))
        return {"n_a": pa.array(np.diff(begin[0])), "n_b": pa.array(np.diff(begin[1])), "n_groups": pa.array(sums(n_groups[window])),
                "n_links": pa.array(sums(many[window])), "groups_sha256": pa.array(digest, pa.string()),
                "pairs": pa.ListArray.from_arrays(lists, pa.array(pair % span)), "times": pa.ListArray.from_arrays(lists, pa.array(times))}


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def alignments(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: a row number, the key, counts, digest of the groups, and distinct id pairs (a times the size of B, plus b) with their links."""
    prepare(docs.sparkSession)
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField(key, docs.schema[key].dataType),
                           *[T.StructField(c, T.LongType()) for c in _COUNTS], T.StructField("groups_sha256", T.StringType()),
                           T.StructField("pairs", longs), T.StructField("times", longs)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = Aligner(path_a, path_b), TaskContext.get().partitionId() << 40
        for b in batches:
            _, offsets = utf8(b.column(1))
            for x, z in slices(offsets):
                made = aligner.batch(texts(b.column(1).slice(x, z - x)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + z - x)), b.column(0).slice(x, z - x),
                                                  *[made[c] for c in schema.names[2:]]], schema.names)
                row += z - x

    return docs.select(key, text).mapInArrow(work, schema)


def pair_counts(aligned: DataFrame, many_b: int) -> DataFrame:
    """Documents that hold each id pair, and whether that is the most of its A id (an A id has at most ``many_b`` pairs)."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    counts = counts.withColumn("a", F.floor(F.col("pair") / many_b))
    return counts.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy("a")))


def link_statistics(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: the key, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256``."""
    spark = docs.sparkSession
    many_b = len(PieceTokens(path_b).bytes)
    aligned = stage(alignments(docs, path_a, path_b, key, text), "aligned")
    counts = stage(pair_counts(aligned, many_b).select("pair", "docs", "best"), "pair-counts")
    total = counts.agg(F.sum("docs")).first()[0] or 0
    is_common = F.col("docs") * COMMON >= F.lit(total)
    table = counts.filter(is_common).toArrow().sort_by("pair")
    common = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "docs", "best")))
    schema = "row long, n_best long, count_sum long, pair long, n long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with the sums over its common pairs, and one for each rare pair."""
        known, docs_of, best = common.value
        for b in batches:
            row, lists, times = b.column(0).to_numpy(), b.column(1), b.column(2).flatten().to_numpy()
            pair = lists.flatten().to_numpy()
            begin = lists.offsets.to_numpy().astype(np.int64)
            begin = begin - begin[0]
            at = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
            hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            many = np.where(hit, docs_of[at] * times, 0) if len(known) else np.zeros(len(pair), np.int64)
            first = np.where(hit & best[at], times, 0) if len(known) else many
            total = [np.concatenate([[0], np.cumsum(x)]) for x in (first, many)]
            none = pa.nulls(len(row), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(row), *[pa.array(x[begin[1:]] - x[begin[:-1]]) for x in total], none, none],
                                             ["row", "n_best", "count_sum", "pair", "n"])
            rest = np.flatnonzero(~hit)
            none = pa.nulls(len(rest), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(row[np.searchsorted(begin, rest, "right") - 1]), none, none, pa.array(pair[rest]), pa.array(times[rest])],
                                             ["row", "n_best", "count_sum", "pair", "n"])

    looked = stage(aligned.select("row", "pairs", "times").mapInArrow(work, schema), "link-sums")
    sums = looked.filter("pair is null").select("row", "n_best", "count_sum")
    rest = (looked.filter("pair is not null").select("row", "pair", "n").join(counts.filter(~is_common), "pair")
            .select("row", F.when(F.col("best"), F.col("n")).otherwise(0).alias("n_best"), (F.col("n") * F.col("docs")).alias("count_sum")))
    sums = sums.unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.select("row", key, *_COUNTS, "groups_sha256").join(sums, "row").select(key, *_COUNTS, "n_best", "count_sum", "groups_sha256")
