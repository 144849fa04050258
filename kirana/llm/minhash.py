"""Near duplicates by circulant MinHash (operator 1).

A text's set holds its five-word shingles.  Two permutations of the 32-bit
universe make all signature coordinates (C-MinHash, Li and Li 2021): coordinate
k is the least pi(sigma(x) - k) over the set, so the second permutation is used
shifted by k around the circle.  ``BANDS`` bands of ``ROWS`` coordinates are the
candidate buckets: a pair at similarity 0.75 misses all of them with a
probability below 6e-6.  Every link is confirmed on the full sets.

No pairs are formed within a group of copies or a bucket:

* texts with equal sets are one class and travel as its smallest document;
* each bucket compares its members with its smallest one only; linked members
  become components;
* buckets whose members are then still in different components, and have not
  all been compared, go on: small ones as pairs across components, large ones
  in tasks of two bounded blocks of members, which compare by matrix product
  and return only links that join components.

So each pair that shares a bucket is either compared or known to be connected.

Defined results: null, empty and blank texts have an empty set and link with
nothing; a null key links with nothing (its component is null, and it is kept);
rows that repeat a key are one node; an empty table returns no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kirana.llm.common import mix64, prepare, stage, utf8
from kirana.llm.components import components
from kirana.llm.shingles import sets, shingles, slices

BANDS, ROWS = 32, 4
#: Similarity at least LINK / 100.
LINK = 75
#: Members of a bucket that may be paired, and members of a block.
SMALL, BLOCK = 16, 256


def _permuted(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit numbers."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(a)
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(b)
    return x ^ (x >> np.uint32(16))


def signatures(hashes: np.ndarray, begin: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Signature of each set; ``begin`` marks non-empty sets in ``hashes``."""
    sigma = _permuted((hashes >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    out = np.empty((coordinates, len(begin)), np.uint32)
    a, b = np.empty_like(sigma), np.empty_like(sigma)
    for k in range(coordinates):
        np.subtract(sigma, np.uint32(k), out=a)
        for shift, factor in ((16, 0x21F0AAAD), (15, 0x735A2D97)):
            np.right_shift(a, np.uint32(shift), out=b)
            np.bitwise_xor(a, b, out=a)
            np.multiply(a, np.uint32(factor), out=a)
        out[k] = np.minimum.reduceat(a, begin)
    return out.T


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key for each band; the band's number is part of it."""
    wide = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), wide.shape[:2])
    for k in range(0, ROWS, 2):
        key = mix64(key + ((wide[:, :, k] << np.uint64(32)) | wide[:, :, k + 1]))
    return key.view(np.int64)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, offsets = utf8(b.column(1))
        for first, end in slices(offsets):
            got, begin = shingles(raw[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first])
            full = np.flatnonzero(np.diff(begin))
            keys: list = [None] * (end - first)
            if len(full):
                for k, row in zip(full.tolist(), bands(signatures(got, begin[full]))):
                    keys[k] = row
            size, mark = [], []
            for k in range(end - first):
                own = np.unique(got[begin[k]:begin[k + 1]])
                size.append(len(own))
                mark.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(first, end - first), pa.array(size, pa.int64()), pa.array(mark, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["key", "size", "mark", "bands"])


def _links(size_a: int, size_b: int, both: int) -> bool:
    return 100 * both >= LINK * (size_a + size_b - both)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, text of a, text of b): those whose sets are similar enough."""
    for b in batches:
        keep = [_links(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))) for x, y in zip(sets(b.column(2)), sets(b.column(3)))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _compare_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the components in two blocks of a bucket's members, one for each join of components."""
    rows = rows.drop_duplicates("key").sort_values("size", ignore_index=True)
    own = sets(pa.array(rows["text"], pa.large_string()))
    size = np.array([len(s) for s in own])
    flat = np.concatenate(own)
    row = np.repeat(np.arange(len(own)), size)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    both = np.zeros((len(own), len(own)), np.float32)
    for first in range(0, int(column.max(initial=-1)) + 1, 1 << 13):
        part = (column >= first) & (column < first + (1 << 13))
        there = np.zeros((len(own), 1 << 13), np.float32)
        there[row[part], column[part] - first] = 1
        both += there @ there.T
    union = size[:, None] + size[None, :] - both
    a, b = np.nonzero(np.triu(100 * both >= LINK * union, 1))
    root = {c: c for c in rows["component"]}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    keys, of = rows["key"].tolist(), rows["component"].tolist()
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(of[x]), find(of[y])
        if p != q:
            root[p] = q
            out.append((keys[x], keys[y]))
    return pd.DataFrame(out, columns=["a", "b"])


def _confirmed(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pairs (a, b) whose texts are similar enough."""
    of = lambda side: candidates.select(F.col("key").alias(side), F.col("text").alias(f"text_{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(_compare, f"a {dict(pairs.dtypes)['a']}, b {dict(pairs.dtypes)['b']}")


def _near(size_a: str, size_b: str):
    """Sizes between which the similarity can reach the bound."""
    return F.least(size_a, size_b) * 100 >= F.greatest(size_a, size_b) * LINK


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the key, ``n_shingles``, ``component_id`` (its smallest key), ``kept``."""
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    lean = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = stage(lean.mapInArrow(_describe, f"key {kind}, size long, mark binary, bands array<long>"), "minhash")
    usable = rows.filter("mark is not null and key is not null")
    classes = stage(usable.groupBy("mark").agg(F.min("key").alias("class")), "minhash-classes")

    firsts = usable.join(classes.select(F.col("class").alias("key")), "key", "left_semi")
    entries = firsts.select("key", "size", F.explode("bands").alias("bucket"))
    buckets = (entries.groupBy("bucket").agg(F.count("*").alias("members"), F.min(F.struct("key", "size")).alias("hub")).filter("members > 1")
               .select("bucket", "members", F.col("hub.key").alias("hub"), F.col("hub.size").alias("hub_size")))
    members = stage(entries.join(buckets, "bucket"), "minhash-members")
    candidates = stage(lean.join(members.select("key").distinct(), "key").dropDuplicates(["key"]), "minhash-candidates")

    stars = members.filter("key != hub").filter(_near("size", "hub_size")).select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct()
    links = stage(_confirmed(stars, candidates), "minhash-links")

    # buckets of three or more members that are not all in one component
    known = components(links)
    labelled = (members.filter("members > 2").join(known.withColumnRenamed("node", "key"), "key", "left")
                .withColumn("component", F.coalesce("component", "key")))
    split = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("bucket")
    open_ = stage(labelled.join(split, "bucket", "left_semi").filter("key != hub").select("bucket", "members", "key", "size", "component"), "minhash-open")

    small = open_.filter(F.col("members") <= SMALL)
    other = small.select("bucket", *(F.col(c).alias(f"{c}_b") for c in ("key", "size", "component")))
    across = (small.join(other, "bucket").filter((F.col("key") < F.col("key_b")) & (F.col("component") != F.col("component_b")) & _near("size", "size_b"))
              .select(F.col("key").alias("a"), F.col("key_b").alias("b")).distinct())
    more = _confirmed(across, candidates)

    large = open_.filter(F.col("members") > SMALL).withColumn("blocks", F.ceil(F.col("members") / BLOCK))
    large = large.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks"))).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    large = large.withColumn("p", F.least("own", "with")).withColumn("q", F.greatest("own", "with"))
    blocks = large.join(candidates, "key").select("bucket", "p", "q", "key", "size", "component", "text")
    more = more.unionByName(blocks.groupBy("bucket", "p", "q").applyInPandas(_compare_blocks, f"a {kind}, b {kind}"))
    links = links.unionByName(stage(more, "minhash-links"))

    found = components(links).withColumnRenamed("node", "class")
    classes = classes.join(found, "class", "left").select("mark", F.coalesce("component", "class").alias("component"))
    done = rows.select("key", "size", F.when(F.col("key").isNotNull(), F.col("mark")).alias("mark")).join(classes, "mark", "left")
    component = F.coalesce("component", "key")
    return done.select(F.col("key").alias(key), F.col("size").alias("n_shingles"), component.alias("component_id"),
                       F.col("key").eqNullSafe(component).alias("kept"))
