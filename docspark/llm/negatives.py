"""Hard negatives by integer scores, multiplied in a residue number system.

Scores are inner products of whole-number vectors. For a few primes p, as many as the largest possible score
asks for, a task takes both matrices modulo p, centred around 0, and multiplies them in float32. The primes
are so small that no sum of products exceeds 2^23, hence every product is exact whatever the order of its
additions. Digits to mixed radix (Garner's form of Chinese remaindering) give the signed scores back; centred
digits of odd primes need no correction of the sign.

Anchors and rows meet in blocks, one pair of blocks each task. Two rounds: the first finds each anchor's
best rows of its own label, its positives; the second, with their scores known, the best rows of other
labels whose score lies in the window of each positive. A task sends `positives` rows per anchor at most,
and `negatives` per anchor and positive. Blocks are dealt by hash, so that labels and equal vectors spread.

Defined cases: rows with a null id, label or vector, or null or non-finite components take no part; rows alike
in id, label and vector count once; different rows of one id are anchors of their own and never each other's
positive or negative; shorter vectors count as padded by zeros; ties go to the smaller id; fewer rows than
asked for give all; a positive without any row in its window gives none; very long vectors make blocks of fewer
rows and are multiplied in parts; empty tables give an empty result; other columns are not read. Components are
held at LIMIT, so that scores of up to 1,024 components fit 62 bits; a bound beyond is an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Components are held within this, far above those of usual vectors.
LIMIT = 1 << 26
#: Components of a block of rows (8,192 rows of 64) and of a block of anchors.
BLOCK = 1 << 19
ANCHOR_BLOCK = 1 << 17
#: Components multiplied at once, scores held at once.
_PART = 1024
_CELLS = 1 << 21

_LEAST = np.iinfo(np.int64).min


def quantized(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component, within LIMIT; null if the vector or a component is null or not finite."""
    whole = F.transform(vector, lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(F.lit(scale) * x.cast("double")))).cast("int"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(F.coalesce(finite, F.lit(False)), whole)


def moduli(width: int, bound: int) -> list[int]:
    """Odd primes whose product exceeds 2 * bound, each small enough for exact sums of `width` products in float32."""
    half = math.isqrt((1 << 23) // min(max(width, 1), _PART))
    primes, product, p = [], 1, 2 * half + 1
    while product <= 2 * bound:
        while any(p % k == 0 for k in range(2, math.isqrt(p) + 1)):
            p -= 1
        if p < 3:
            raise ValueError(f"scores of up to {bound} exceed the residue system")
        primes.append(p)
        product, p = product * p, p - 1
    return primes


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues from -(p - 1) / 2 to (p - 1) / 2 of whole float32 numbers below 2^24; the second pass mends rounding."""
    for _ in range(2):
        x = x - np.float32(p) * np.rint(x * np.float32(1 / p))
    return x


def residues(vectors: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    out = []
    for p in primes:
        r = vectors % np.int64(p)
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products of all rows of a with all of b, from their residues."""
    digits: list[np.ndarray] = []
    value, weight = np.zeros((len(a[0]), len(b[0])), np.int64), 1
    for i, p in enumerate(primes):
        rest = np.zeros(value.shape, np.float32)
        for k in range(0, a[i].shape[1], _PART):
            rest = _centred(rest + _centred(a[i][:, k : k + _PART] @ b[i][:, k : k + _PART].T, p), p)
        for digit, q in zip(digits, primes, strict=False):
            inverse = np.float32(pow(q, -1, p))
            rest = _centred(_centred(rest - digit, p) * inverse, p)
        digits.append(rest)
        value += rest.astype(np.int64) * weight
        weight *= p
    return value


def best(values: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest fitting values of each row, the leftmost of equal ones."""
    masked = np.where(fits, values, _LEAST)
    if masked.shape[1] > k:
        limit = np.partition(masked, masked.shape[1] - k, axis=1)[:, -k][:, None]
        above = masked > limit
        level = fits & (masked == limit)
        spare = k - above.sum(axis=1, keepdims=True)
        fits = above | level
        crowded = np.flatnonzero(level.sum(axis=1) > spare[:, 0])  # ties at the limit: the first ones stay
        fits[crowded] = above[crowded] | (level[crowded] & (np.cumsum(level[crowded], axis=1) <= spare[crowded]))
    return np.nonzero(fits)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    out = np.zeros((len(lists), width), np.int32)
    sizes = np.diff(lists.offsets.to_numpy())
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


def _tiles(anchors: pa.Table, rows: pa.Table, width: int, primes: list[int]):
    """Scores of slices of anchors with all rows, by ascending id: (slice of anchors, ids, labels, scores)."""
    if not anchors.num_rows or not rows.num_rows:
        return
    rows = rows.sort_by("id")
    ids, labels = rows["id"].to_numpy(), rows["row_label"].to_numpy()
    b = residues(_matrix(rows["row"], width), primes)
    a = residues(_matrix(anchors["v"], width), primes)
    step = max(1, _CELLS // max(1, len(ids)))
    for i in range(0, anchors.num_rows, step):
        yield slice(i, i + step), ids, labels, scores([x[i : i + step] for x in a], b, primes)


def _best_positives(width: int, primes: list[int], k: int):
    def tile(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        for at, ids, labels, score in _tiles(anchors, rows, width, primes):
            own, own_label, key = (anchors[c].to_numpy()[at] for c in ("vec_id", "label", "anchor"))
            i, j = best(score, (labels == own_label[:, None]) & (ids != own[:, None]), k)
            out.append((key[i], own[i], ids[j], score[i, j]))
        return _table(("anchor", "anchor_id", "positive_id", "positive_score"), out)

    return tile


def _best_negatives(width: int, primes: list[int], k: int, low: int, high: int):
    def tile(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        for at, ids, labels, score in _tiles(anchors, rows, width, primes):
            own, own_label, key = (anchors[c].to_numpy()[at] for c in ("vec_id", "label", "anchor"))
            other = (labels != own_label[:, None]) & (ids != own[:, None])
            mine = anchors["positives"][at].to_pylist()
            for place in range(max(map(len, mine), default=0)):
                has = np.flatnonzero([len(x) > place for x in mine])
                p = np.array([mine[x][place]["positive_score"] for x in has], np.int64)
                p_id = np.array([mine[x][place]["positive_id"] for x in has], np.int64)
                # whole-number ends of low * p <= 100 * score <= high * p
                ends = [(-((-low * int(x)) // 100), high * int(x) // 100) for x in p]
                first, last = np.array(ends, np.int64).reshape(-1, 2).T[:, :, None]
                part = score[has]
                i, j = best(part, other[has] & (part >= first) & (part <= last), k)
                out.append((key[has][i], np.full(len(i), place, np.int64), own[has][i], p_id[i], ids[j], p[i], part[i, j]))
        return _table(("anchor", "place", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"), out)

    return tile


def _table(names: tuple[str, ...], parts: list[tuple[np.ndarray, ...]]) -> pa.Table:
    columns = zip(*parts, strict=True) if parts else [[] for _ in names]
    return pa.table([np.concatenate(list(c)) if c else np.zeros(0, np.int64) for c in columns], names=list(names))


def mine(
    vectors: DataFrame, is_anchor: Column, stored, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = BLOCK
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for (vec_id, label, v).

    An anchor's positives are its `positives` best other rows of its label; for each, the `negatives` best rows
    of other labels with low * positive_score <= 100 * negative_score <= high * positive_score are ranked.
    `stored` writes a table and reads it back. One row of bounds reaches the driver.
    """
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "v")
    whole = whole.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).distinct()
    rows = stored(whole.withColumn("anchor", F.xxhash64("vec_id", "label", "v")))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    facts = rows.agg(
        F.max(F.size("v")).alias("width"), F.max(square).alias("all"), F.max(F.when(is_anchor, square)).alias("asked"),
        F.count(F.lit(1)).alias("rows"), F.count(F.when(is_anchor, 1)).alias("anchors"),
    ).first()
    width = facts["width"] or 1
    # no product exceeds the product of the lengths
    bound = int(math.sqrt((facts["all"] or 0) * (facts["asked"] or 0)) * (1 + 1e-9)) + 1
    if bound >= 1 << 62:
        raise ValueError(f"scores of up to {bound} exceed 62 bits")
    primes = moduli(width, bound)
    db = max(1, -(-facts["rows"] * width // block))
    ab = max(1, -(-facts["anchors"] * width // min(ANCHOR_BLOCK, block)))
    asked = rows.where(is_anchor).withColumn("ab", F.pmod(F.xxhash64(F.lit(1), "anchor"), F.lit(ab)).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # names of their own: both sides of the cogroup come from one table
    data = rows.select(F.col("vec_id").alias("id"), F.col("label").alias("row_label"), F.col("v").alias("row"), F.pmod("anchor", F.lit(db)).cast("int").alias("db"), every(ab).alias("ab"))
    data = data.groupBy("ab", "db")
    first = _best_positives(width, primes, positives)
    found = asked.select("anchor", "vec_id", "label", "v", "ab", every(db).alias("db")).groupBy("ab", "db").cogroup(data)
    found = found.applyInArrow(first, "anchor long, anchor_id long, positive_id long, positive_score long")
    ordered = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    chosen = found.withColumn("place", F.row_number().over(ordered)).where(F.col("place") <= positives)
    chosen = chosen.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))
    asked = stored(asked.join(chosen, "anchor").select("anchor", "vec_id", "label", "v", "ab", "positives"))
    second = _best_negatives(width, primes, negatives, low, high)
    found = asked.select("anchor", "vec_id", "label", "v", "positives", "ab", every(db).alias("db")).groupBy("ab", "db").cogroup(data)
    found = found.applyInArrow(second, "anchor long, place long, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    ordered = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
