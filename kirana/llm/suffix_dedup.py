"""Removal of repeated strings by distributed prefix doubling (operator 10).

A start is a byte position whose next ``LENGTH`` bytes lie in its document.
Each start is represented by a sampled position: the one with the least hash of
its ``GRAM`` bytes among those that lie wholly in the start's string (leftmost
of equals).  The choice depends on the string alone, so equal strings choose at
the same place, and all consecutive starts with one choice form a unit.

Ranks are identities of strings at a position: hashes of GRAM bytes to begin
with, and in each round of pairs of an old string and its extension, so that
the compared length grows towards LENGTH while a unit is cut into fewer starts:

* Spark sorts the units by rank; units whose rank is unique are done, as none
  of their starts can repeat;
* units of a rank are compared by the string that their starts cover together;
  one whose covered string occurs in an earlier unit is covered wholly;
* the first units of the different covered strings under a rank go on to the
  next round, cut at the widths in ``WIDTHS``; the last width is one start, whose
  rank is the identity of all LENGTH bytes.

Rows that travel hold two hashes, a document and a span.  Ranks that repeat
inside one task are known not to be unique; all but one of their rows are dealt
out evenly, so that a passage shared by a third of all documents doesn't meet
in one task.

Defined results: null and empty texts, and texts under LENGTH bytes, lose
nothing; a document with a null key takes no part and is returned whole; rows
that repeat a key and its text are one document and get the same result each;
rows of one key with different texts are documents of their own, ordered by the
SHA-256 of their texts; equal strings in one document are ordered by start; an empty table returns no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kirana.llm.common import drop_stage, mix64, prepare, stage, utf8
from kirana.llm.shingles import slices

LENGTH = 100
#: Bytes whose hash chooses the sampled position.
GRAM = 24
#: Starts that a unit may hold in each round.
WIDTHS = (LENGTH - GRAM + 1, 11, 1)

_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_SALTS = (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(family: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of a family and their inverses, modulo 2 to the 64."""
    known = _POWERS.get(family)
    if known is None or len(known[0]) < n:
        out = []
        for base in (_BASES[family], pow(_BASES[family], -1, 1 << 64)):
            p = np.full(n, np.uint64(base))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        known = _POWERS[family] = tuple(out)
    return known


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number."""
    x = raw.astype(np.uint64)
    for k in (1, 2, 4):
        x = (x[:-k] << np.uint64(8 * k)) | x[k:]
    return x


class Ranges:
    """Identities of byte ranges of at least eight bytes."""

    def __init__(self, eight: np.ndarray, family: int):
        self.power, self.inverse = _powers(family, len(eight) + 1)
        value = mix64(eight ^ np.uint64(_SALTS[family])) * self.power[:len(eight)]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])

    def of(self, first: np.ndarray, end: np.ndarray, tag: np.ndarray | int = 0) -> np.ndarray:
        got = (self.sums[end - 7] - self.sums[first]) * self.inverse[first]
        return mix64(got + (end - first).astype(np.uint64) * np.uint64(_BASES[0]) + np.asarray(tag, np.uint64) * np.uint64(_BASES[1]))


def _grams(eight: np.ndarray) -> np.ndarray:
    n = len(eight) - GRAM + 8
    out = np.zeros(n, np.uint64)
    for k in range(0, GRAM, 8):
        out = mix64(out + eight[k:k + n])
    return out


def _least(x: np.ndarray, window: int) -> np.ndarray:
    """The least value in each window of consecutive values."""
    width = 1
    while 2 * width <= window:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[:len(x) - (window - width)], x[window - width:]) if window > width else x


def units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text number, first start, last start, sampled position (all in ``raw``), rank and covered string of each unit."""
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none, none, none, none, none, none
    eight = eights(raw)
    gram = _grams(eight)
    bits = np.uint64(max(1, int(len(raw)).bit_length()))
    packed = ((gram >> bits) << bits) | np.arange(len(gram), dtype=np.uint64)
    chosen = (_least(packed, WIDTHS[0]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(chosen)]
    start = np.flatnonzero(np.arange(len(chosen)) + LENGTH <= offsets[1:][text])
    if not len(start):
        return none, none, none, none, none, none
    new = np.ones(len(start), bool)
    new[1:] = (np.diff(chosen[start]) != 0) | (np.diff(start) != 1)
    at = np.flatnonzero(new)
    lo, hi = start[at], start[np.append(at[1:] - 1, len(start) - 1)]
    a = chosen[lo]
    covered = Ranges(eight, 1).of(lo, hi + LENGTH, a - lo)
    return text[lo], lo, hi, a, gram[a].view(np.int64), covered.view(np.int64)


_ROW = "rank long, covered long, doc long, span long"


def _span(lo: np.ndarray, hi: np.ndarray, a: np.ndarray) -> np.ndarray:
    """First start, width and offset of the sampled position in one number, ordered by the start."""
    return (lo << 16) | ((hi - lo) << 8) | (a - lo)


def _batch(rank, covered, doc, span) -> pa.RecordBatch:
    """Units with where to deal them: ranks that repeat here are sure to go on, and all but one row of them are spread."""
    order = np.argsort(rank, kind="stable")
    same = np.zeros(len(rank), bool)
    if len(rank):
        again = rank[order][1:] == rank[order][:-1]
        same[order[1:]] = again
        sure = same.copy()
        sure[order[:-1]] |= again
    else:
        sure = same
    deal = np.where(same, mix64(span.view(np.uint64) ^ mix64(doc.view(np.uint64))).view(np.int64), rank)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (rank, covered, doc, span, deal, sure)], ["rank", "covered", "doc", "span", "deal", "sure"])


def _first_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, offsets = utf8(b.column(1))
        docs = b.column(0).to_numpy(zero_copy_only=False)
        parts = []
        for first, end in slices(offsets):
            base = offsets[first]
            text, lo, hi, a, rank, covered = units(raw[base:offsets[end]], offsets[first:end + 1] - base)
            begin = offsets[first:end][text] - base
            parts.append((rank, covered, docs[first:end][text].astype(np.int64), _span(lo - begin, hi - begin, a - begin)))
        yield _batch(*(np.concatenate(x) for x in zip(*parts))) if parts else _batch(*[np.zeros(0, np.int64)] * 4)


def _cut(width: int):
    """Cuts the units (``spans`` of each text) to ``width`` starts and ranks the string that every start of a cut holds."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = utf8(b.column(1))
            docs, spans = b.column(0).to_numpy(), b.column(2)
            parts = []
            for k in range(b.num_rows):
                eight = eights(raw[offsets[k]:offsets[k + 1]])
                span = np.array(spans[k].as_py(), np.int64)
                lo, wide, before = span >> 16, (span >> 8) & 255, span & 255
                a = np.repeat(lo + before, wide + 1)
                start = np.repeat(lo, wide + 1) + np.arange(len(a)) - np.repeat(np.cumsum(wide + 1) - wide - 1, wide + 1)
                cell = (a - start) // width
                new = np.ones(len(a), bool)
                new[1:] = (np.diff(a) != 0) | (np.diff(cell) != 0) | (np.diff(start) != 1)
                at = np.flatnonzero(new)
                first, last = start[at], start[np.append(at[1:] - 1, len(a) - 1)]
                a, cell = a[at], cell[at]
                latest = a - cell * width
                rank = Ranges(eight, 0).of(latest, latest - width + 1 + LENGTH, cell)
                covered = Ranges(eight, 1).of(first, last + LENGTH, a - first)
                parts.append((rank.view(np.int64), covered.view(np.int64), np.full(len(a), docs[k], np.int64), _span(first, last, a)))
            if parts:
                yield _batch(*(np.concatenate(x) for x in zip(*parts)))
    return work


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by rank, those whose rank is not unique."""
    held, before = None, None  # the last row so far, and the rank before it
    for b in batches:
        t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
        rank = t.column("rank").to_numpy()
        if not len(rank):
            continue
        alike = np.empty(len(rank) + 1, bool)
        alike[1:-1] = rank[1:] == rank[:-1]
        alike[0], alike[-1] = before is not None and before == rank[0], False
        keep = t.column("sure").to_numpy() | alike[:-1] | alike[1:]
        last = len(rank) - 1
        before = rank[last - 1] if last else before
        held = t.slice(last).to_batches()[0]
        yield from t.slice(0, last).filter(pa.array(keep[:last])).select(["rank", "covered", "doc", "span"]).to_batches()
    if held is not None:
        r, s = held.column(0)[0].as_py(), held.column(5)[0].as_py()
        if s or (before is not None and before == r):
            yield held.select(["rank", "covered", "doc", "span"])


def _rounds(ids: DataFrame) -> DataFrame:
    """Spans (doc, span) of starts that repeat an earlier one."""
    dealt = _ROW + ", deal long, sure boolean"
    found, arena = None, None
    now = ids.mapInArrow(_first_units, dealt)
    for step, width in enumerate(WIDTHS):
        ranked = stage(now.repartition("deal").sortWithinPartitions("rank").mapInArrow(_repeated, _ROW), f"ranks-{width}")
        strings = ranked.groupBy("rank", "covered").agg(F.min(F.struct("doc", "span")).alias("first"), F.count("*").alias("n"))
        strings = stage(strings, f"strings-{width}")
        # the files of a round's shuffles go when the driver collects its garbage, which may be long after
        ids.sparkSession.sparkContext._jvm.System.gc()
        again = (ranked.join(strings.filter("n > 1").select("rank", "covered", "first"), ["rank", "covered"])
                 .filter(F.struct("doc", "span") != F.col("first")).select("doc", "span"))
        found = again if found is None else found.unionByName(again)
        if step + 1 == len(WIDTHS):
            drop_stage(arena)
            return found
        several = strings.groupBy("rank").agg(F.count("*").alias("k")).filter("k > 1").select("rank")
        heads = strings.join(several, "rank", "left_semi").select("first.*")
        cuts = heads.groupBy("doc").agg(F.array_sort(F.collect_list("span")).alias("spans"))
        texts = arena.select("doc", "text").join(cuts, "doc") if arena else ids.join(cuts, "doc").dropDuplicates(["doc"])
        before, arena = arena, stage(texts.select("doc", "text", "spans"), f"texts-{width}")
        if before:
            drop_stage(before)
        now = arena.mapInArrow(_cut(WIDTHS[step + 1]), dealt)
    raise AssertionError


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text, as bytes."""
    for b in batches:
        raw, offsets = utf8(b.column(1))
        n_bytes, removed, runs, kept = [], [], [], []
        for k in range(b.num_rows):
            own = raw[offsets[k]:offsets[k + 1]]
            spans = b.column(2)[k].as_py()
            n_bytes.append(len(own))
            if not spans:
                removed.append(0)
                runs.append(0)
                kept.append(own.tobytes())
                continue
            span = np.unique(np.array(spans, np.int64))
            lo = span >> 16
            edge = np.zeros(len(own) + 1, np.int64)
            np.add.at(edge, lo, 1)
            np.add.at(edge, lo + ((span >> 8) & 255) + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed.append(int(gone.sum()))
            runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            kept.append(own[~gone].tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                                         ["key", "n_bytes", "n_removed", "n_spans", "kept"])


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, doc): ``doc`` is the key, or where keys repeat a number in order of key and text."""
    lean = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if not lean.filter("key is not null").groupBy("key").count().filter("count > 1").limit(1).count():
        return lean.withColumn("doc", F.col("key"))
    lean = lean.withColumn("mark", F.when(F.col("key").isNotNull(), F.sha2("text", 256)))
    numbers = (lean.filter("key is not null").select("key", "mark").distinct().orderBy("key", "mark")
               .withColumn("doc", F.monotonically_increasing_id()))
    return lean.join(stage(numbers, "numbers"), ["key", "mark"], "left").select("key", "text", "doc")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, span) of starts whose LENGTH bytes also start earlier; a span packs its first start, width and sample.

    Rows of one key must hold one text (``without_repeats`` numbers them where they don't)."""
    prepare(docs.sparkSession)
    return _rounds(docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter("doc is not null"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the key, ``n_bytes``, ``n_removed``, ``n_spans``, and ``kept``, the bytes left."""
    own = _documents(docs, key, text)
    spans = repeated_spans(own, "doc", "text").groupBy(F.col("doc").alias("of")).agg(F.collect_list("span").alias("spans"))
    joined = own.join(spans, F.col("doc") == F.col("of"), "left").select("key", "text", "spans")
    out = joined.mapInArrow(_rest, f"key {dict(docs.dtypes)[key]}, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("key", key)
