"""Toxicity by a weighted finite-state pattern grammar (operator 6).

The grammar of ``clauses.py`` finds clauses; what counts as an insult, and how
much each kind of clause weighs, is learnt from labelled rows:

1. From at most about ``SAMPLE_ROWS`` labelled documents, exact copies but for case
   and white space taken once, the lexicon: words and beginnings of words that stand in many
   toxic and few other documents, with their log odds as weights.
2. A logistic regression over the clause weights by kind.

Scores read the text alone.  Both steps end in a few thousand numbers at the
driver, bounded by the sample; all documents are scored in one pass.

Defined results: null and empty texts have no clauses and get the score of
a text without any; without labelled rows the prior weights hold; repeated
rows and null keys return a row each (a null key counts as held out); an empty
table returns no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kirana.llm.clauses import KINDS, REPORTED, THREAT, TOKEN, Grammar, entries
from kirana.llm.common import prepare, squeezed, stage, texts

#: Labelled documents that the model is fitted on, about; all of them if there are no more.
SAMPLE_ROWS = 20_000
FOLDS = 5
#: A lexicon entry stands in so many toxic documents at least, with such log odds and certainty.
LEAST_DOCUMENTS, LEAST_ODDS, LEAST_Z = 4, 2.5, 4.0
#: Bias and weights before any row is seen, and how firmly they hold.
PRIOR = np.array([-4.0] + [0.6] * 3 + [0.1] * 2 + [0.5, 0.0])
FIRM = 0.05


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "utf-8")) % FOLDS == 0, F.lit(True))


def features(grammar: Grammar, text: str) -> list[float]:
    """Bias, weight by kind of clause, the heaviest word, matches by hundred words."""
    found, words = grammar.clauses(text)
    by_kind = [0.0] * KINDS
    for kind, weight in found:
        by_kind[kind] += weight or 4.0
    full = [w for k, w in found if k <= THREAT]
    return [1.0, *map(math.log1p, by_kind), max(full, default=0.0), math.log1p(100 * len(full) / (words or 1))]


def _entries_of(text: str) -> set[str]:
    return {e for w in set(TOKEN.findall(text.lower())) for e in entries(w)}


def _counts(rows: DataFrame, only: set[str] | None, least: int) -> dict[str, int]:
    """Documents that hold each entry."""
    share = rows.sparkSession.sparkContext.broadcast(only) if only is not None else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        def out():
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["entry", "n"])
        for b in batches:
            for t in texts(b.column(0)):
                got = _entries_of(t)
                found.update(got if share is None else got & share.value)
                if len(found) > 300_000:
                    yield out()
                    found.clear()
        yield out()

    sums = rows.select("text").mapInArrow(work, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return dict(zip(*(c.to_pylist() for c in sums.toArrow().columns)))


def _lexicon(rows: DataFrame) -> dict[str, float]:
    many = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    bad, good = many.get(1, 0), many.get(0, 0)
    if not bad:
        return {}
    in_bad = _counts(rows.filter("toxic = 1"), None, LEAST_DOCUMENTS)
    in_good = _counts(rows.filter("toxic = 0"), set(in_bad), 1)
    out = {}
    for entry, a in in_bad.items():
        cells = [x + 0.5 for x in (a, bad - a, in_good.get(entry, 0), good - in_good.get(entry, 0))]
        odds = math.log(cells[0] * cells[3] / (cells[1] * cells[2]))
        if odds >= LEAST_ODDS and odds >= LEAST_Z * math.sqrt(sum(1 / x for x in cells)):
            out[entry] = odds
    return out


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, held by the prior."""
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + FIRM * (w - PRIOR)
        bend = (x * (p * (1 - p))[:, None]).T @ x + FIRM * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    w[1 + REPORTED - 1:1 + REPORTED + 1] = np.minimum(w[1 + REPORTED - 1:1 + REPORTED + 1], w[1:4].max())
    return w


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        sample_rows: int = SAMPLE_ROWS) -> tuple[dict[str, float], np.ndarray]:
    """Lexicon and weights, learnt from the labelled rows outside the held-out fold."""
    prepare(docs.sparkSession)
    open_ = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).filter(~held_out(F.col(key)))
    open_ = open_.groupBy(F.col(key).alias("its")).agg(F.max(label).cast("int").alias("toxic"))
    share = min(1.0, sample_rows / max(open_.count(), 1))
    sample = open_.filter(F.pmod(F.xxhash64("its"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # the sample's size is bounded by a parameter, so it may be broadcast
    rows = docs.select(F.col(key).alias("its"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(sample), "its")

    # copies but for case and white space; texts that only share passages stay
    same = F.sha2(F.lower(squeezed(F.col("text"))), 256)
    once = rows.groupBy(same.alias("same"), "toxic").agg(F.max("text").alias("text")).select("text", "toxic")
    rows = stage(once, "toxic-sample")
    lexicon = _lexicon(rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(grammar, t) for t in texts(b.column(0))], pa.list_(pa.float64())), b.column(1)], ["x", "toxic"])

    seen = rows.select("text", "toxic").mapInArrow(measure, "x array<double>, toxic int").toArrow()
    if not seen.num_rows:
        return lexicon, PRIOR
    return lexicon, _fit(np.array(seen.column(0).to_pylist()), np.array(seen.column(1).to_pylist(), float))


def _scores(grammar: Grammar, weights: np.ndarray, column: pa.Array) -> np.ndarray:
    x = np.array([features(grammar, t) for t in texts(column)]).reshape(-1, len(weights))
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def without_toxic(docs: DataFrame, model: tuple[dict[str, float], np.ndarray], text: str = "text") -> DataFrame:
    """The documents, with all their columns, whose score is below 0.5."""
    prepare(docs.sparkSession)
    share, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(share.value[0])
        for b in batches:
            yield b.filter(pa.array(_scores(grammar, share.value[1], b.column(at)) < 0.5))

    return docs.mapInArrow(work, docs.schema)


def score(docs: DataFrame, model: tuple[dict[str, float], np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ``held_out``, ``score`` (0 to 1), ``predicted``."""
    prepare(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[key]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(share.value[0])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(grammar, share.value[1], b.column(1)))], [key, "score"])

    scored = docs.select(key, text).mapInArrow(work, f"`{key}` {kind}, score double")
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
