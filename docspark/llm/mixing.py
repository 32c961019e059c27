"""Mixing sources to target weights by capped water-filling.

`targets` gives each source its weighted part of the whole, stopped at a number of epochs of what the
source has; what the stopped sources leave is shared again by weight until none is above its limit.
In one pass: sources ordered by limit / weight are stopped from the front, and the level of the rest is
the first that stops no further source. `sample` meets a target with whole repetitions of every row and
one seeded part of the rows once more: the seeded order as far as it stays within the target, then, from the
largest size to the smallest, as many rows as still fit what is missing, and one row more if that comes nearer.
So no row that is left out would fit. Rows alike in id, text and source are numbered, so that the seeded
order has single rows, in whatever number a row is repeated. Everything is DataFrame work; no source and no
repeated row is gathered in a task: what is known of a source is broadcast to the rows as long as there are
at most BROADCAST_SOURCES of them, and dealt out with a salt beyond.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of its
own, last in order; repeated rows count each; an empty table gives an empty result; without any size
all targets are 0; a very long text is a row like any other, and where every text is longer than what a source
misses, the source stays that short of its target. Other columns are kept as they are, those named `_source` and the like included, as
the work is done on a struct of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import block_of, bloom, mask_of, numbered

#: Weights of sources in order, repeating.
CYCLE = (5, 2, 1)
MAX_EPOCHS = 3
#: Buckets of the seeded order of one source; only rows of the bucket where the target falls are sorted.
BUCKETS = 1024
#: Blocks of 8 bytes of the filter that keeps rows without copies where they are.
FILTER_BLOCKS = 1 << 17
#: Sources whose facts are broadcast at most, and parts that a source is dealt into beyond.
BROADCAST_SOURCES = 10_000
SALTS = 32

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """Weights by the order of the sources' code points, null last, the cycle repeating.

    `sizes` has one row per source, so the order is that of a catalogue, not of documents.
    Comparison of UTF-8 bytes is comparison of code points.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    return sizes.withColumn("weight", F.element_at(weights, (place % len(cycle) + 1).cast("int")))


def targets(weighted: DataFrame, max_epochs: float = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """Add `target` to (source, source_size, weight): the weighted part of the whole, stopped at the limit."""
    limit = F.col("source_size") * F.lit(float(max_epochs))
    rows = weighted.withColumn("_limit", limit).withColumn("_level", F.col("_limit") / F.col("weight"))
    everything = Window.partitionBy()
    front = Window.orderBy(F.col("_level"), F.col("source").asc_nulls_last())
    before = front.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("_whole", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_stopped", F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    rows = rows.withColumn("_mean", (F.col("_whole") - F.col("_stopped")) / F.col("_open"))
    # the first source that its limit does not stop fixes the level of all that follow
    water = F.min(F.when(F.col("_mean") <= F.col("_level"), F.struct("_level", "_mean"))).over(everything)["_mean"]
    filled = F.least(F.col("_limit"), F.col("weight") * water)
    return rows.withColumn("target", F.coalesce(filled, F.col("_limit"))).select("source", "source_size", "weight", "target")


def with_order(rows: DataFrame, seed: int, buckets: int) -> DataFrame:
    """Add `_order`, the place of a row (key, copy, size) in the seeded order of its source, its bucket first."""
    hash_ = F.when(F.col("copy") == 0, F.xxhash64(F.lit(seed), "key")).otherwise(F.xxhash64(F.lit(seed), "key", "copy"))
    bucket = F.pmod(F.shiftright(hash_, 20), F.lit(buckets)).cast("int")
    return rows.withColumn("_order", F.struct(bucket.alias("bucket"), hash_.alias("hash"), "key", "copy", "size"))


def limits(sized: DataFrame, goals: DataFrame, sources: int, seed: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """How far the mix goes into each source: (source, source_size, target, whole, first, last, picked).

    Every row is taken `whole` times, `floor(target / source_size)`. For what is left, the rows in buckets
    before `first`, those of that bucket up to `last`, and of each size in `picked` the other rows up to a place
    are taken once more. Sums of buckets find the bucket where the target falls, and only its rows are added up one
    by one; what is missing then is less than one row, and numbers of rows per size decide how it is filled.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.select("source", "source_size", "target", whole.alias("whole"))
    goals = goals.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    rows = with_order(sized, seed, buckets)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        rows.groupBy("source", F.col("_order.bucket").alias("bucket")).agg(F.sum("size").alias("sum"))
        .withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0).cast("long")))
    )
    over = F.col("before") + F.col("sum") > F.col("rest")
    fall = _with(sums, goals, sources).groupBy("source").agg(
        F.min(F.when(over, F.struct("bucket", "before"))).alias("fall"), F.first("rest").alias("rest")
    )
    fall = fall.select("source", "rest", F.coalesce("fall.bucket", F.lit(buckets)).alias("first"), "fall.before")
    upto = Window.partitionBy("source").orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = _with(rows, fall, sources).where(F.col("_order.bucket") == F.col("first"))
    inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(upto)).where(F.col("upto") <= F.col("rest"))
    last = inside.groupBy("source").agg(F.max("_order").alias("last"), F.max("upto").alias("upto"))
    fall = _with(fall, last, sources, "left").withColumn("gap", F.col("rest") - F.coalesce("upto", "before"))
    fall = fall.select("source", "first", "last", "gap")
    # rows above twice the gap would not bring the source nearer
    behind = _with(rows, fall, sources).where(~_inside() & (F.col("size") > 0) & (F.col("size") < 2 * F.col("gap")))
    picked = _picked(behind, buckets)
    return _with(_with(goals.drop("rest"), fall.drop("gap"), sources, "left"), picked, sources, "left")


_TAKEN = "array<struct<size:bigint,n:bigint>>"


def _fill(sizes: Column, gap: Column) -> Column:
    """(size, n) of the rows that fill the gap, from (size, n) by falling size.

    As many as fit of each size; or, if that comes nearer, up to some size and one row of it too many.
    """
    none = F.array().cast(_TAKEN)
    over = F.struct(F.lit(float("inf")).alias("miss"), none.alias("taken"))
    start = F.struct(gap.cast("double").alias("gap"), none.alias("taken"), over.alias("over"))

    def step(state: Column, of: Column) -> Column:
        n = F.least(of["n"], F.floor(state["gap"] / of["size"])).cast("long")
        rest = state["gap"] - n * of["size"]
        with_n = lambda n: F.concat(state["taken"], F.array(F.struct(of["size"].alias("size"), n.alias("n"))))
        one_more = F.struct((of["size"] - rest).alias("miss"), with_n(n + 1).alias("taken"))
        nearer = (n < of["n"]) & (of["size"] - rest < state["over"]["miss"])
        return F.struct(
            rest.alias("gap"), F.when(n > 0, with_n(n)).otherwise(state["taken"]).alias("taken"),
            F.when(nearer, one_more).otherwise(state["over"]).alias("over"),
        )

    return F.aggregate(sizes, start, step, lambda s: F.when(s["over"]["miss"] < s["gap"], s["over"]["taken"]).otherwise(s["taken"]))


def _picked(behind: DataFrame, buckets: int) -> DataFrame:
    """(source, picked): for each size, the place in the seeded order up to which its rows behind the target are taken.

    A source has at most as many sizes here as its gap, which is below one text, has words.
    """
    keys = [F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_null")]
    behind = behind.select("source", *keys, "size", "gap", "_order")
    counted = behind.groupBy("source", "_s", "_null", "size").agg(F.count(F.lit(1)).alias("n"), F.first("gap").alias("gap"))
    falling = F.reverse(F.array_sort(F.collect_list(F.struct("size", "n"))))
    listed = counted.groupBy("source", "_s", "_null").agg(falling.alias("sizes"), F.first("gap").alias("gap"))
    wanted = listed.select("_s", "_null", F.explode(_fill(F.col("sizes"), F.col("gap"))).alias("w")).select("_s", "_null", F.col("w.size").alias("size"), F.col("w.n").alias("wanted"))
    placed = numbered(behind, ["_s", "_null", "size"], F.col("_order.bucket").cast("long"), ["_order"], "_number", buckets)
    taken = placed.join(wanted, ["_s", "_null", "size"]).where(F.col("_number") < F.col("wanted"))
    upto = taken.groupBy("source", "size").agg(F.max("_order").alias("upto"))
    return upto.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("size", "upto"))).alias("picked"))


def _with(left: DataFrame, right: DataFrame, sources: int, how: str = "inner") -> DataFrame:
    """Join with facts of the sources, one row each, null being a source as well."""
    right = right.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if sources <= BROADCAST_SOURCES:
        return left.join(F.broadcast(right), same, how).drop("_source")
    salted = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    right = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(right, same & (F.col("_salt") == F.col("_part")), how).drop("_source", "_salt", "_part")


def _inside() -> Column:
    return F.coalesce((F.col("_order.bucket") < F.col("first")) | (F.col("_order") <= F.col("last")), F.lit(False))


def sample(rows: DataFrame, how_far: DataFrame, sources: int, seed: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """Add `source_size`, `target` and `repeats`, how often the mix takes the row, to rows (source, size, key, copy, ...)."""
    joined = _with(with_order(rows, seed, buckets), how_far, sources)
    once = _inside() | F.coalesce(F.col("_order") <= F.try_element_at("picked", F.col("size")), F.lit(False))
    repeats = F.when(F.col("size") > 0, F.col("whole") + once.cast("long")).otherwise(0)
    return joined.withColumn("repeats", repeats.cast("long")).drop("_order", "whole", "first", "last", "picked")


def _alike() -> Column:
    """The hash that copies share: of id, text and source."""
    return F.xxhash64("key", "source")


def with_copy(rows: DataFrame, stored) -> DataFrame:
    """Add `copy`, numbers from 0 among rows that are alike; which of them has which number is not fixed."""
    placed = rows.withColumns({"_alike": _alike(), "_at": F.monotonically_increasing_id()})
    # once stored, a place stays
    return numbered(stored(placed), ["_alike"], F.xxhash64("_at"), ["_at"], "copy").drop("_alike", "_at")


def whole_rows(docs: DataFrame, columns: list[Column], sized: DataFrame, stored) -> DataFrame:
    """The rows of `docs` in `row` beside the columns, with `copy`; only rows that may be repeated are shuffled."""
    sieve = F.broadcast(bloom(sized.where("copy = 1"), _alike(), FILTER_BLOCKS))
    packed = docs.select(*columns, F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    marked = packed.join(sieve, block_of(_alike(), FILTER_BLOCKS) == F.col("_block"), "left")
    maybe = F.coalesce(F.col("_bits").bitwiseAND(mask_of(_alike())) == mask_of(_alike()), F.lit(False))
    single = marked.where(~maybe).drop("_block", "_bits").withColumn("copy", F.lit(0).cast("long"))
    return single.unionByName(with_copy(marked.where(maybe).drop("_block", "_bits"), stored))


def mix(docs: DataFrame, stored, seed: int = 0, max_epochs: float = MAX_EPOCHS, keep_rows: bool = False) -> DataFrame:
    """How often the mix takes each document: (doc_id, source, size, source_size, target, repeats[, row]).

    `stored` writes a table and reads it back, for sizes are read several times. With `keep_rows` the
    whole row follows in `row`. Of documents alike in id, text and source, any that many are taken as fit.
    """
    columns = [
        docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), word_count(docs["text"]).alias("size"),
        F.xxhash64(docs["doc_id"], docs["text"]).alias("key"),
    ]
    sized = stored(with_copy(docs.select(*columns), stored))
    sizes = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = sizes.count()
    how_far = stored(limits(sized, targets(cyclic_weights(sizes), max_epochs), sources, seed))
    rows = whole_rows(docs, columns, sized, stored) if keep_rows else sized
    return sample(rows, how_far, sources, seed).drop("key", "copy")


def repeated(mixed: DataFrame) -> DataFrame:
    """The rows of the mix itself: each taken row as often as the mix takes it."""
    taken = mixed.where(F.col("repeats") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).select("row.*")
