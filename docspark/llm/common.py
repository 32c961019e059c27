"""Batches, words, hashes and gapless numbers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text that are hashed at once.
SLICE_BYTES = 1 << 20

#: The bytes that separate words: 0x20 and 0x09 to 0x0D.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C55)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that all bits of the result depend on all bits of the input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse up to n; the tables are kept while they are of usual size."""
    if len(_powers[0]) > n:
        return _powers
    size = max(n + 1, 2 * SLICE_BYTES)
    tables = []
    for base in (_BASE, _BASE_INVERSE):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        tables.append(np.cumprod(steps, dtype=np.uint64))
    if size <= 4 * SLICE_BYTES:
        _powers[:] = tables
    return tables


class Texts:
    """The bytes of some texts in one array, with hashes of any range of them.

    `offsets[i]` to `offsets[i + 1]` is text i; a null is an empty text.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        column = column.cast(pa.large_string())
        if column.null_count:
            column = column.fill_null("")
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        body = column.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
        self.data = data[offsets[0] : offsets[-1]]
        if lower:
            self.data = _LOWER[self.data]
        self.offsets = offsets - offsets[0]
        self._sums: np.ndarray | None = None

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every word, a word being a run of bytes that do not separate."""
        solid = ~_BLANK[self.data]
        size = len(solid)
        edge = np.zeros(size + 1, bool)
        edge[self.offsets] = True
        begin, finish = solid.copy(), solid.copy()
        if size:
            begin[1:] &= ~solid[:-1] | edge[1:size]
            finish[:-1] &= ~solid[1:] | edge[1:size]
        starts = np.flatnonzero(begin)
        return starts, np.flatnonzero(finish) + 1, self.text_of(starts)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, side="right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges: a polynomial from running sums, mixed with the length."""
        power, inverse = _power_tables(len(self.data))
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)], dtype=np.uint64, out=self._sums[1:])
        value = (self._sums[ends] - self._sums[starts]) * inverse[starts]
        return mix(value + (ends - starts).astype(np.uint64) * _STEP)


def window_hashes(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n neighbouring words of one text, and the place of their first word."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            total = total * _STEP + hashes[j : j + count]
    first = np.flatnonzero(owner[:count] == owner[n - 1 :])
    return mix(total[first] + np.uint64(n)), first


class Rolling:
    """Hashes of all windows of a sequence, of any length, from one running sum of hashes times powers."""

    def __init__(self, hashes: np.ndarray):
        power, self._inverse = _power_tables(len(hashes))
        self._sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * power[: len(hashes)], dtype=np.uint64, out=self._sums[1:])

    def windows(self, n: int) -> np.ndarray:
        """Hash of the window of n entries that begins at each place; none if there are fewer entries."""
        count = max(0, len(self._sums) - n)
        return mix((self._sums[n:] - self._sums[:count]) * self._inverse[:count] + np.full(1, n, np.uint64) * _STEP)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one take `limit` bytes at most, or are a single text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        total, start = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                total, start = 0, i
            total += size
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # the worker goes on to other tasks


def per_text(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values of each of n texts."""
    return np.bincount(owner, weights=values, minlength=n).astype(np.int64) if len(owner) else np.zeros(n, np.int64)


def block_of(hash_: Column, blocks: int) -> Column:
    """Block of a blocked Bloom filter that a 64-bit hash belongs to."""
    return F.pmod(F.shiftright(hash_, 24), F.lit(blocks).cast("long"))


def mask_of(hash_: Column, bits: int = 4) -> Column:
    """Some bits of a 64-bit word, from the 24 low bits of the hash."""
    mask = F.lit(0).cast("long")
    for i in range(bits):
        place = F.shiftright(hash_, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return mask


def bloom(hashes: DataFrame, hash_: Column, blocks: int) -> DataFrame:
    """The filter of some hashes: rows (_block, _bits), `blocks` of them at most, however many hashes."""
    return hashes.groupBy(block_of(hash_, blocks).alias("_block")).agg(F.bit_or(mask_of(hash_)).alias("_bits"))


def numbered(df: DataFrame, group: list[str], spread: Column, order: list, name: str, buckets: int = 256) -> DataFrame:
    """Add gapless numbers from 0 inside each group, without gathering a group in one task.

    Rows are dealt into buckets by the hash `spread`; the buckets' counts give each bucket its first
    number, and only a bucket is sorted. `df` is read twice: store it if it is costly. Rows that tie
    in `order` must be alike, since any of them may come first.
    """
    dealt = df.withColumn("_bucket", F.pmod(spread, F.lit(buckets)).cast("int"))
    keys = [*group, "_bucket"]
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # both sides are dealt by bucket: dealing by group alone, as the window of the sums would, gathers a hot group
    firsts = (
        dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_first"))
        .repartition(*keys)
    )
    inside = dealt.repartition(*keys).withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    return inside.join(firsts, keys).withColumn(name, F.col("_first") + F.col("_place")).drop("_bucket", "_first", "_place")
