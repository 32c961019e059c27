"""Shards of nearly equal bytes by longest-processing-time scheduling.

Rows with equal texts form a group that must stay together. Groups go, largest first, to the least
loaded shard. Only sizes matter for that, so the schedule is made on counts of groups per size, a table
whose length does not grow with the data: sizes are exact below 256 bytes and carry 8 leading bits
above, with their true mean. A heap of shards takes the size classes in falling order; a class with more
groups than shards first levels the shards, then deals rounds. The result is a quota per class and shard;
groups get their number inside the class without being gathered, and the quota their shard.

Defined cases: a null text counts as empty, so it is of the group of empty texts; repeated rows are kept,
each with its own slot; an empty table gives an empty result; other columns are ignored by name.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import numbered

SHARDS = 24
ROW_BYTES = 8
_EXACT_BITS = 8


def size_class(size: Column) -> Column:
    """The size with its 8 leading bits only."""
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.floor(F.log2(size.cast("double"))) + 1 - _EXACT_BITS))
    return (F.floor(size / step) * step).cast("long")


def _level(loads: list[float], amount: float) -> float:
    """The load that all shards below it reach when the amount is poured into them."""
    ordered, total = sorted(loads), amount
    for n, load in enumerate(ordered, 1):
        total += load
        if n == len(ordered) or total / n <= ordered[n]:
            return total / n
    return amount


def schedule(classes: list[tuple[int, int, float]], shards: int) -> list[tuple[int, int, int, int]]:
    """Quotas (class, shard, first number, end number) for classes (class, groups, mean size), by a heap of loads.

    Groups of one class are alike, so a shard may take several at a time as long as it would have been
    chosen for each: up to the load of the next shard of the heap.
    """
    heap = [(0.0, shard) for shard in range(shards)]
    quotas = []
    for label, groups, size in sorted(classes, reverse=True):
        taken: dict[int, int] = defaultdict(int)
        left = groups
        while left:
            if left >= 4 * shards:
                # many alike: fill every shard up to just below the level that the class reaches
                level = _level([load for load, _ in heap], left * size)
                bulk = {shard: max(0, int((level - load) / size) - 1) for load, shard in heap}
                if any(bulk.values()):
                    for shard, n in bulk.items():
                        taken[shard] += n
                    left -= sum(bulk.values())
                    heap = [(load + bulk[shard] * size, shard) for load, shard in heap]
                    heapq.heapify(heap)
                    continue
            load, shard = heap[0]
            heapq.heapreplace(heap, (load + size, shard))
            taken[shard] += 1
            left -= 1
        first = 0
        for shard in sorted(taken):
            if taken[shard]:
                quotas.append((label, shard, first, first + taken[shard]))
                first += taken[shard]
    return quotas


def shard(docs: DataFrame, stored, shards: int = SHARDS) -> DataFrame:
    """Shard and slot of every row: (doc_id, size, text_crc32, shard, slot).

    `stored` writes a table and reads it back: digests of the texts are computed once.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs["text"], F.lit(""))
    rows = stored(
        docs.select(
            docs["doc_id"].alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("digest"),
        )
    )
    groups = rows.groupBy("digest").agg((F.count(F.lit(1)) * F.first("size")).alias("bytes"))
    groups = stored(groups.select("digest", "bytes", size_class(F.col("bytes")).alias("class")))
    # at most 128 classes for each doubling of the size
    classes = groups.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.avg("bytes").alias("mean")).collect()
    quotas = schedule([(r["class"], r["n"], r["mean"]) for r in classes], shards)
    table = spark.createDataFrame(quotas, "class long, shard int, first long, end long")
    ranked = numbered(groups, ["class"], F.xxhash64("digest"), ["digest"], "number")
    fits = (ranked["class"] == table["class"]) & (ranked["number"] >= table["first"]) & (ranked["number"] < table["end"])
    homes = ranked.join(F.broadcast(table), fits).select("digest", "shard")
    placed = stored(rows.join(homes, "digest").drop("digest"))
    spread = F.xxhash64("doc_id", "text_crc32")
    return numbered(placed, ["shard"], spread, ["doc_id", "text_crc32", "size"], "slot", buckets=1024)
