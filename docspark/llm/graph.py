"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.session import unstage


def unread(*frames: DataFrame) -> None:
    """Delete what was stored for frames that no later step reads."""
    unstage(*[f for f in frames if hasattr(f, "staged_at")])


def components(edges: DataFrame, stored) -> DataFrame:
    """(node, root) of every node that has an edge to another, root being the component's smallest node.

    `edges` has columns a, b of type long. Each round first hangs the larger neighbours of every node on
    the smallest one, then the node's smaller neighbours and itself; when nothing changes, all nodes hang
    on their root. The number of rounds grows with the logarithm of the longest path. `stored` writes a
    table and reads it back; only a count and a checksum of the edges reach the driver. What a round has
    stored is deleted as soon as the next has read it.
    """

    def mark(rows: DataFrame) -> tuple:
        # sums of half hashes stay within a long
        return tuple(rows.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("a", "b"), 24))).first())

    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges)
    state = mark(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large)
        unread(edges)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        unread(large)
        before, state = state, mark(edges)
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
