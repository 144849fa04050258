"""Ranked lexical search by presence masks (operator 12).

1. One scan counts, for every document, its terms and how often each term of the
   items occurs; the sums N and L and the document frequencies come from that table.
2. Within a block of documents every term of the items has a bitmap of the documents
   that hold it.  OR-ing an item's bitmaps, one bit a term, gives each document its
   presence mask; documents of one mask form a group.  A mask's highest score is the
   sum of its terms' weights, each with the term's largest share in the block.  Masks
   are evaluated by falling highest score, and the item is finished when the next one
   lies below the k-th score that the task knows.  Only what may be among the k best of
   a block leaves it; a window ranks the few rows left.

Items are worked on in blocks of at most ``BLOCK_BYTES`` of text, so what is broadcast
(the terms of a block, their weights) is bounded; a longer item is a block of its own.
Terms are told apart by 64-bit hashes.

Defined results: a null or empty item has no rows, a null or empty text is never found;
equal scores are ranked by the key, null keys last; repeated rows, of documents or items,
each count for themselves; with either table empty there are no rows; other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kirana.llm.common import mix64, prepare, stage, utf8
from kirana.llm.shingles import slices

#: Bytes of item text whose terms are broadcast together.
BLOCK_BYTES = 1 << 23
#: Documents that are grouped together, and 64-bit words of their masks.
BLOCK_DOCS = 8192
BLOCK_WORDS = 1 << 20
#: Masks are evaluated until about so many documents more have a score.
STEP = 64

_rng = np.random.default_rng(20240712)
_LETTER = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_LENGTH = np.uint64(0xA0761D6478BD642F)
_LETTER[65:91] = _LETTER[97:123]
_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each term and, for each text, the number of its first term (length + 1)."""
    inside = _IN_TERM[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[heads] = inside[heads]
    at = np.flatnonzero(starts)
    first = np.searchsorted(at, offsets)
    if not len(at):
        return np.zeros(0, np.uint64), first
    letters = np.add.reduceat(inside, at, dtype=np.int64)
    power = np.full(int(letters.max()), _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    where = np.flatnonzero(inside)  # the letters of a term stand together
    begin = np.cumsum(letters) - letters
    value = _LETTER[raw[where]] * power[np.arange(len(where)) - np.repeat(begin, letters)]
    return mix64(np.add.reduceat(value, begin) + letters.astype(np.uint64) * _LENGTH), first


def _lists(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _item_blocks(items: DataFrame, key: str, text: str) -> DataFrame:
    """Items with their distinct terms, how often each occurs, and the block they belong to."""
    size = items.agg(F.sum(F.octet_length(text))).first()[0] or 0
    kind = items.schema[key].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("item", T.LongType()), T.StructField(key, kind),
                           T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        block = item = part << 40
        filled = 0
        for b in batches:
            raw, offsets = utf8(b.column(1))
            for a, z in slices(offsets):
                got, first = terms(raw[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a])
                blocks, names, times = [], [], []
                for k in range(z - a):
                    own, n = np.unique(got[first[k]:first[k + 1]].view(np.int64), return_counts=True)
                    more = int(offsets[a + k + 1] - offsets[a + k])
                    if filled and filled + more > BLOCK_BYTES:
                        block, filled = block + 1, 0
                    filled += more
                    blocks.append(block)
                    names.append(own)
                    times.append(n.astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blocks, pa.int64()), pa.array(range(item, item + z - a), pa.int64()), b.column(0).slice(a, z - a),
                     pa.array(names, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))], schema.names)
                item += z - a

    return stage(items.select(key, text).coalesce(max(1, math.ceil(size / BLOCK_BYTES))).mapInArrow(work, schema), "item-terms")


def _term_counts(docs: DataFrame, key: str, text: str, known) -> DataFrame:
    """For each document with a term: the key, its number of terms, and the items' terms in it with their counts."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n", T.LongType()),
                           T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.IntegerType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = known.value
        for b in batches:
            raw, offsets = utf8(b.column(1))
            for a, z in slices(offsets):
                got, first = terms(raw[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a])
                at = np.minimum(np.searchsorted(asked, got), len(asked) - 1)
                hit = np.flatnonzero(asked[at] == got)
                doc = np.searchsorted(first, hit, "right") - 1
                pair, times = np.unique(doc * len(asked) + at[hit], return_counts=True)
                begin = np.searchsorted(pair, np.arange(z - a + 1) * len(asked))
                out = pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, z - a), pa.array(np.diff(first)), _lists((pair % len(asked)).astype(np.int32), begin),
                     _lists(times.astype(np.int32), begin)], schema.names)
                yield out.filter(pa.array(np.diff(first) > 0))

    return docs.select(key, text).mapInArrow(work, schema)


class _Block:
    """Documents of a block by row and by term, with each term's share of a document's score."""

    def __init__(self, n: np.ndarray, begin: np.ndarray, term: np.ndarray, times: np.ndarray, n_terms: int, docs_all: int, terms_all: int):
        self.begin, self.term = begin, term
        doc = np.repeat(np.arange(len(n)), np.diff(begin))
        m = 25 + (75 * n * docs_all) // terms_all
        self.share = (1_000_000_000 * times) // (1000 * times + 8 * m[doc])
        order = np.argsort(term, kind="stable")
        self.of_term = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.docs = doc[order]
        self.most = np.zeros(n_terms, np.int64)
        np.maximum.at(self.most, term, self.share)
        self.weight = np.zeros(n_terms, np.int64)
        self.size = len(n)

    def groups(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct masks as bits (one row each), the documents in order of mask, and where each mask's begin (length + 1)."""
        words = -(-len(asked) // 64)
        mask = np.zeros((self.size, words), np.uint64)
        for k, t in enumerate(asked.tolist()):
            mask[self.docs[self.of_term[t]:self.of_term[t + 1]], k >> 6] |= np.uint64(1 << (k & 63))
        live = np.flatnonzero(mask.any(axis=1))
        mask = mask[live]
        order = np.lexsort(mask.T) if words > 1 else np.argsort(mask[:, 0], kind="stable")
        mask = mask[order]
        new = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]).any(axis=1)])) if len(mask) else np.zeros(0, np.int64)
        bits = np.unpackbits(mask[new].view(np.uint8), axis=1, bitorder="little")[:, :len(asked)]
        return bits, live[order], np.append(new, len(mask))

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Scores of documents, with the item's weights in place."""
        first, many = self.begin[docs], self.begin[docs + 1] - self.begin[docs]
        ends = np.cumsum(many)
        at = np.arange(ends[-1]) + np.repeat(first - (ends - many), many)
        return np.add.reduceat(self.weight[self.term[at]] * self.share[at], ends - many)

    def best(self, asked: np.ndarray, weights: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents that may be among the k best and their scores, and the k best scores known (smallest first) after them."""
        bits, docs, begin = self.groups(asked)
        most = bits.astype(np.int64) @ (weights * self.most[asked])
        order = np.argsort(-most, kind="stable")
        found, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.weight[asked] = weights
        many = np.diff(begin)[order]
        at = 0
        while at < len(order) and most[order[at]] > 0 and most[order[at]] >= least[0]:
            end = at + 1 + int(np.searchsorted(np.cumsum(many[at:]), STEP))
            own = np.concatenate([docs[begin[g]:begin[g + 1]] for g in order[at:end]])
            got = self.scores(own)
            keep = (got > 0) & (got >= least[0])
            found.append(own[keep])
            scores.append(got[keep])
            least = np.sort(np.concatenate([least, got[keep]]))[-k:]
            at = end
        self.weight[asked] = 0
        found, scores = np.concatenate(found), np.concatenate(scores)
        keep = scores >= least[0]
        return found[keep], scores[keep], least


def _search_block(counted: DataFrame, key: str, item_key: str, item_kind: T.DataType, items: pa.Table, known: np.ndarray, k: int) -> DataFrame:
    """At most k rows for each item and block of documents: every document among the k best is in them."""
    spark = counted.sparkSession
    docs_all, terms_all = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    weight = np.zeros(len(known), np.int64)
    for t, df in counted.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        weight[t] = math.floor(1000 * math.log((2 * docs_all + 2) / (2 * df + 1)))
    spec = []
    for names, times in zip(items.column("terms").to_pylist(), items.column("times").to_pylist()):
        asked = np.searchsorted(known, np.array(names, np.int64).view(np.uint64))
        spec.append((asked, weight[asked] * np.array(times, np.int64)))
    numbers, names = items.column("item").combine_chunks(), items.column(item_key).combine_chunks()
    shared = spark.sparkContext.broadcast((spec, numbers, names, docs_all, terms_all))
    n_terms = len(known)
    schema = T.StructType([T.StructField("_item", T.LongType()), T.StructField(item_key, item_kind),
                           T.StructField(f"_{key}", counted.schema[key].dataType), T.StructField("score", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, numbers, names, docs_all, terms_all = shared.value
        widest = max((len(asked) for asked, _ in spec), default=1)
        rows = max(1, min(BLOCK_DOCS, BLOCK_WORDS * 64 // max(widest, 1)))
        least = np.zeros((len(spec), k), np.int64)

        def search(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            keys, lists, times = (table.column(c).chunk(0) for c in (0, 2, 3))
            begin = _numbers(lists.offsets).astype(np.int64)
            flat, often = lists.values.slice(0), times.values
            begin_t = _numbers(times.offsets)
            block = _Block(_numbers(table.column(1).chunk(0)), begin - begin[0], _numbers(flat)[begin[0]:begin[-1]].astype(np.int64),
                           _numbers(often)[begin_t[0]:begin_t[-1]].astype(np.int64), n_terms, docs_all, terms_all)
            place = np.empty(len(keys), np.int64)
            place[_numbers(pc.sort_indices(keys, null_placement="at_end"))] = np.arange(len(keys))
            item, doc, score = [], [], []
            for i, (asked, weights) in enumerate(spec):
                found, got, least[i] = block.best(asked, weights, k, least[i])
                if len(found):
                    first = np.lexsort((place[found], -got))[:k]
                    item.append(np.full(len(first), i))
                    doc.append(found[first])
                    score.append(got[first])
            if item:
                item = pa.array(np.concatenate(item))
                yield pa.RecordBatch.from_arrays([numbers.take(item), names.take(item), keys.take(pa.array(np.concatenate(doc))),
                                                  pa.array(np.concatenate(score))], schema.names)

        held: list[pa.RecordBatch] = []
        for b in batches:
            for a in range(0, b.num_rows, rows):
                held.append(b.slice(a, rows))
                if sum(x.num_rows for x in held) >= rows:
                    yield from search(pa.Table.from_batches(held))
                    held = []
        if held:
            yield from search(pa.Table.from_batches(held))

    return counted.mapInArrow(work, schema)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k documents with the highest score above 0 for each item: ``item_key``, ``rank``, ``key`` and ``score``."""
    spark = docs.sparkSession
    prepare(spark)
    asked = _item_blocks(items, item_key, item_text)
    blocks = [r[0] for r in asked.select("block").distinct().sort("block").collect()]
    found = []
    for block in blocks:
        own = asked.filter(F.col("block") == block).filter(F.size("terms") > 0).toArrow()
        if not own.num_rows:
            continue
        known = np.unique(np.concatenate([np.array(t, np.int64) for t in own.column("terms").to_pylist()]).view(np.uint64))
        counted = stage(_term_counts(docs, key, text, spark.sparkContext.broadcast(known)), "term-counts")
        found.append(_search_block(counted, key, item_key, items.schema[item_key].dataType, own, known, k))
    if not found:
        kinds = T.StructType([T.StructField(item_key, items.schema[item_key].dataType), T.StructField("rank", T.IntegerType()),
                              T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.LongType())])
        return spark.createDataFrame([], kinds)
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.col(f"_{key}").asc_nulls_last())
    return (rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select(item_key, "rank", F.col(f"_{key}").alias(key), "score"))
