"""Connected components of a table of links.

Alternates the two star operations of Kiveris et al., "Connected Components in
MapReduce and Beyond" (2014): every node hands its larger neighbours, then its
smaller ones, the smallest node it knows, until no link changes.  Each round is
two aggregations of minima (summed before the shuffle) and two joins; its links
are written to the shared folder, and only their count and checksum reach the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kirana.llm.common import drop_stage, stage


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first())


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star operation on links (a, b) with a > b."""
    both = links if not large else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root"))
    told = both.join(least, F.col("a") == F.col("node"))
    out = told.filter("b > a") if large else told
    out = out.select(F.col("b").alias("a"), F.col("root").alias("b"))
    if not large:
        out = out.unionByName(least.select(F.col("node").alias("a"), F.col("root").alias("b")))
    else:
        # links to smaller neighbours stay, towards the root
        out = out.unionByName(least.filter("root < node").select(F.col("node").alias("a"), F.col("root").alias("b")))
    return out.filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that has a link; the component is its smallest node.

    ``links`` has the columns a and b; order, repeats and loops don't matter.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    now = stage(ordered, "links")
    mark = _mark(now)
    while mark[0]:
        after = stage(_star(_star(now, True), False), "links")
        drop_stage(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
