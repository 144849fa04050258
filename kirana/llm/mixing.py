"""Mixing sources to target weights with a low-discrepancy schedule (operator 7).

Each source is a stream of its documents in a shuffled order (MD5 of the seed
and the key), cut into blocks of equal size.  Slot t of the schedule gets the
van der Corput point of t; the point falls into one source's share of the
cumulative weights; slots are ranked within their source, and the slot of rank
k takes block k of the source's stream.  A stream starts over when it is used
up, at most ``MOST`` times.

What is taken of a source is what its slots take, so it differs from the target
by as many blocks as points stray from the share, a few of at least ``SLOTS``
(or of one word each, where there are fewer words).

Nothing is gathered by source: ranks and stream positions are running sums
over chunks and within chunks, so a source that holds a third of all words is
spread over its chunks.  The table of sources is aggregated first and holds a
row for each source.

Defined results: a null or empty text has size 0, and such a document is taken
0 words; a null source is a source of its own, the last one; every row is a
document, so rows that repeat a key follow one another in the stream, ordered
by the MD5 of their texts; a null key is a key.  Empty tables return no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kirana.llm.common import WORD, prepare, stage

#: Weights of the sources in order, repeated as often as needed.
WEIGHTS = (5, 2, 1)
#: Times that a source may be used in whole.
MOST = 3
#: A block is at most so many words, and there are at least so many slots if there are as many words.
BLOCK_WORDS, SLOTS = 256, 1 << 20
SEED = "mix"
#: Slots in a chunk, cells of the unit interval, and hexadecimal digits that name a chunk of a stream.
CHUNK, CELLS, STREAM_DIGITS = 1 << 16, 1 << 10, 3


def van_der_corput(t: Column, bits: int = 40) -> Column:
    """The binary digits of t, mirrored at the point."""
    mirrored = F.conv(F.reverse(F.lpad(F.bin(t), bits, "0")), 2, 10).cast("double")
    return mirrored / F.lit(float(1 << bits))


def mark(text: Column) -> Column:
    """Tells the texts of one key apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sizes(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """A number for each row, its key, source and words, and a hash of its text."""
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(source).alias("source"), words.alias("size"), mark(F.col(text)).alias("mark"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: its place, words, weight, and the share of all words that it should get.

    With sources in the order of how soon their cap is reached, the capped ones
    come first; the rest share what those leave, by weight.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("words"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("place", place)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("place", F.lit(len(weights))) + 1)
    per = per.withColumn("weight", weight).withColumn("cap", F.lit(MOST) * F.col("words"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, all_ = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("words").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / weight_left).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(all_)
    target = F.when(level.isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), level * F.col("weight")))
    return per.select("source", "place", "words", target.alias("target")).withColumn("take", F.round("target").cast("long"))


def block_size(per: DataFrame, block_words: int = BLOCK_WORDS, slots: int = SLOTS) -> int:
    """Words of a block: ``block_words``, or fewer for ``slots`` blocks."""
    return max(1, min(block_words, (per.agg(F.sum("take")).first()[0] or 0) // slots))


def schedule(per: DataFrame, block_words: int, point: Callable[[Column], Column] = van_der_corput) -> DataFrame:
    """One row per slot: ``slot``, the source's ``place`` and the ``block`` of its stream; ``point`` places slots in [0, 1)."""
    spark = per.sparkSession
    total = per.agg(F.sum("take")).first()[0] or 0
    slots = -(-total // block_words)
    ordered = Window.orderBy("place")
    shares = per.filter("take > 0").select(
        "place", (F.sum("take").over(ordered) / F.lit(total)).alias("to"), (F.sum("take").over(ordered) - F.col("take")).alias("below"))
    shares = shares.withColumn("from", F.col("below") / F.lit(total)).drop("below")
    cell = lambda c: F.least(F.floor(c * CELLS), F.lit(CELLS - 1))
    shares = shares.withColumn("cell", F.explode(F.sequence(cell(F.col("from")), cell(F.col("to")))))
    points = spark.range(slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("u")).withColumn("cell", cell(F.col("u")))
    drawn = points.join(shares, "cell").filter("u >= from and u < to").select("slot", "place")
    # a source whose share is below a slot still gets one, after all others
    missed = per.filter("take > 0").join(drawn.select("place").distinct(), "place", "left_anti")
    drawn = drawn.unionByName(missed.select((F.lit(slots) + F.col("place")).alias("slot"), "place"))
    drawn = drawn.withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    earlier = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = drawn.groupBy("place", "chunk").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("place", "chunk").orderBy("slot")) - 1
    return drawn.withColumn("rank", rank).join(chunks, ["place", "chunk"]).select("slot", "place", (F.col("rank") + F.col("ahead")).alias("block"))


def streams(rows: DataFrame, per: DataFrame, seed: str = SEED) -> DataFrame:
    """One row per document: its source's place and where the document starts in the shuffled stream."""
    found = rows.join(per.select(F.col("source").alias("its"), "place"), F.col("source").eqNullSafe(F.col("its"))).drop("its")
    order = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("key").cast("string"), F.lit(""))))
    found = found.withColumn("at", order).withColumn("chunk", F.substring("at", 1, STREAM_DIGITS))
    earlier = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = found.groupBy("place", "chunk").agg(F.sum("size").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    within = Window.partitionBy("place", "chunk").orderBy("at", "key", "size", "mark", "row").rowsBetween(Window.unboundedPreceding, -1)
    return (found.withColumn("behind", F.coalesce(F.sum("size").over(within), F.lit(0)))
            .join(chunks, ["place", "chunk"]).withColumn("start", F.col("behind") + F.col("ahead")).drop("chunk", "at", "behind", "ahead"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block_words: int = BLOCK_WORDS,
        seed: str = SEED, slots: int = SLOTS, point: Callable[[Column], Column] = van_der_corput) -> tuple[DataFrame, DataFrame]:
    """Documents with their words in the mix, and the schedule.

    The documents: key, ``source``, ``mark`` (of the text), ``size``, ``source_size``, ``target`` (of its source),
    ``start`` (in its source's stream), ``source_take`` (words that the source's slots take), ``taken`` (words that
    the scheduled blocks hold of it), ``first_slot`` and ``n_slots`` (in which it occurs).
    The schedule: one row for each piece of a document in a slot: ``slot``, ``place``, ``block``, key, ``words``.
    """
    prepare(docs.sparkSession)
    rows = stage(sizes(docs, key, text, source), "mix-sizes")
    per = stage(targets(rows), "mix-targets")
    each = block_size(per, block_words, slots)
    plan = stage(schedule(per, each, point), "mix-slots")
    counts = plan.groupBy("place").agg(F.count("*").alias("blocks"))
    # one row a source, written so that Spark knows its size when it joins
    drawn = stage(per.join(counts, "place", "left").select("place", "words", "target", F.coalesce(F.least(F.col("blocks") * each, F.lit(MOST) * F.col("words")), F.lit(0)).alias("drawn")), "mix-drawn")
    placed = stage(streams(rows, per, seed), "mix-streams")
    runs = placed.filter("size > 0").join(drawn.select("place", "words", "drawn"), "place").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(MOST - 1))))
    runs = runs.withColumn("lo", F.col("start") + F.col("epoch") * F.col("words")).filter("lo < drawn")
    runs = runs.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("drawn")))
    pieces = runs.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / each), F.floor((F.col("hi") - 1) / each))))
    overlap = F.least("hi", (F.col("block") + 1) * each) - F.greatest("lo", F.col("block") * each)
    used = pieces.select("place", "block", "row", "key", overlap.alias("piece")).join(plan, ["place", "block"])
    taken = used.groupBy(F.col("row").alias("its")).agg(F.sum("piece").alias("taken"), F.min("slot").alias("first_slot"), F.count_distinct("slot").alias("n_slots"))
    mixed = (placed.join(taken, F.col("row") == F.col("its"), "left")
             .join(drawn.select(F.col("place").alias("of"), F.col("words").alias("source_size"), "target", F.col("drawn").alias("source_take")), F.col("place") == F.col("of")))
    return (mixed.select(F.col("key").alias(key), "source", "mark", "size", "source_size", "target", "start", "source_take",
                         F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", F.coalesce("n_slots", F.lit(0)).alias("n_slots")),
            used.select("slot", "place", "block", F.col("key").alias(key), F.col("piece").alias("words")))
