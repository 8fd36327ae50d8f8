"""Connected components of a graph given as a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.scratch import forget, written


def downward(links: DataFrame) -> DataFrame:
    """Links (a, b) with the larger node first, each once."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def stars(links: DataFrame) -> DataFrame:
    """(node, root), as a stored table, for every node of `links` (columns a, b) that isn't the smallest of its component; root is.

    Each round hangs a node's larger neighbours, then its smaller ones, on the smallest
    node in sight; components of n nodes need about log n rounds. A node's minimum is
    aggregated before the shuffle and stored, so both sides of the joins are plain
    shuffles whose large partitions adaptive execution splits: a node may have any
    number of links. A round's tables are deleted when the next one is stored.
    """
    now = written(downward(links), "links")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "minima")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large-stars")
        forget(now, least)
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "minima")
        down = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(downward(down.unionByName(least.select("a", F.col("m").alias("b")))), "small-stars")
        forget(large, least)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            hung = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            hung._lectern_path = now._lectern_path
            return hung
        seen = state
