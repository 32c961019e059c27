"""Vectors: encoding, nearest neighbours, similarity.

Exact search streams the corpus past the queries. A query side of a checked
size is broadcast, so the corpus is read once and never shuffled; a larger one
is joined over Voronoi cells, so that a row is shuffled once and a query goes
only to the cells that its bound reaches. Where a sample of the queries shows
that cells leave little out, as of vectors without clusters, parts of bounded
size of both sides meet in blocks instead. Every way a task keeps only the best
k per query, and only those rows are shuffled for the final ranking.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.operators import centres
from docspark.operators.kb import block_label

BROADCAST_BYTES = 64 * 1024 * 1024
GROUP_BYTES = 64 * 1024 * 1024
#: Parts of a group's queries that are copied and searched one after the other.
GROUP_PARTS = 8
MAX_CELLS = 1 << 16
#: Bytes that an id of the index takes at most, as `vector_id` makes them.
ID_BYTES = 128
#: Corpus rows that bound the distances of an exact search beforehand.
SAMPLE_ROWS = 2048
#: Vectors of the corpus that a task holds at once where the queries are broadcast.
BLOCK_BYTES = 16 * 1024 * 1024
#: A block of this many rows is searched by a product of single precision first, in tiles of TILE_ROWS for QUERY_ROWS.
BLOCK_ROWS = 2048
TILE_ROWS = 4096
QUERY_ROWS = 512
#: Groups that the blocks of an exact search give at least, where rows suffice.
MIN_GROUPS = 64
#: Queries that tell what share of the rows cells would have to look at, and up to which share they are used.
PROBE_ROWS = 256
CELL_SHARE = 0.2
#: Voronoi cells at most, and bytes of the sample that their pivots are fitted on.
MAX_PIVOTS = 1024
PIVOT_BYTES = 32 * 1024 * 1024


def similarity(distance: Column) -> Column:
    """1 / (1 + distance), negative distances as 0, null kept."""
    d = distance.cast("double")
    return F.when(d.isNotNull(), F.lit(1.0) / (F.lit(1.0) + F.greatest(d, F.lit(0.0))))


def effective_top_k(requested: Column, default: int) -> Column:
    """Requested k, or the default for null and 0."""
    return F.coalesce(F.nullif(requested, F.lit(0)), F.lit(default))


def embed(
    df: DataFrame,
    text: str,
    make_encoder: Callable[[], Callable[[list[str]], Any]],
    dim: int,
    batch_size: int = 500,
    out: str = "embedding",
) -> DataFrame:
    """Add a vector column by a user function.

    `make_encoder` runs once per task and returns a function from a list of
    texts to vectors; every vector must have `dim` numbers.
    """
    if batch_size <= 0:
        raise ValueError("batch_size must be above zero")
    if dim <= 0:
        raise ValueError("dim must be above zero")
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                texts = part.column(text).fill_null("").to_pylist()
                vectors = np.asarray(encode(texts), dtype=np.float32)
                if vectors.shape != (len(texts), dim):
                    raise ValueError(
                        f"expected {len(texts)} vectors of {dim} numbers, got {vectors.shape}"
                    )
                starts = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim)
                made = pa.ListArray.from_arrays(starts, pa.array(vectors.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, out])

    return df.mapInArrow(run, schema)


def _top_k_function(k: int) -> Callable[..., Any]:
    """Best k of a block of vectors for every query; ships with the task."""

    def distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
        d = q - c
        return (d * d).sum(axis=1)

    def plain(
        qv: np.ndarray, qids: np.ndarray | None, ids: np.ndarray, cv: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query positions, ids and squared distances: the k nearest ids of each query.

        With `qids` a query's own id is left out. An id counts once, with its
        nearest vector. A matrix product finds the candidates, including
        everything within rounding error of the k-th; their distances are then
        summed term by term, so equal vectors tie exactly and the id decides.
        """
        by_id = np.argsort(ids, kind="stable")
        ids, cv = ids[by_id], cv[by_id]
        heads = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, int)
        qn, cn = (qv * qv).sum(axis=1), (cv * cv).sum(axis=1)
        rows, outs_i, outs_d = [], [], []
        step = max(1, 2_000_000 // max(1, len(cv)))
        for lo in range(0, len(qv) if len(cv) else 0, step):
            part = slice(lo, lo + step)
            approx = qn[part, None] + cn[None, :] - 2.0 * (qv[part] @ cv.T)
            if qids is not None:
                approx[qids[part, None] == ids[None, :]] = np.inf
            nearest = approx if len(heads) == len(ids) else np.minimum.reduceat(approx, heads, axis=1)
            limit = np.full(len(approx), np.finfo(float).max)
            if nearest.shape[1] > k:
                kth = np.partition(nearest, k - 1, axis=1)[:, k - 1]
                limit = np.minimum(limit, kth + 1e-9 * (1.0 + np.abs(kth) + qn[part]))
            qi, ci = np.nonzero(approx <= limit[:, None])
            exact = np.empty(len(qi))
            for a in range(0, len(qi), 200_000):
                b = slice(a, a + 200_000)
                exact[b] = distances(qv[lo + qi[b]], cv[ci[b]])
            kept = k_nearest(qi, ids[ci], exact, k)
            rows.append(kept[0] + lo)
            outs_i.append(kept[1])
            outs_d.append(kept[2])
        if not rows:
            return np.zeros(0, np.int64), ids[:0], np.zeros(0)
        return np.concatenate(rows), np.concatenate(outs_i), np.concatenate(outs_d)

    def marked(marks: np.ndarray) -> np.ndarray:
        """Places of the few true values, looked for eight at a time."""
        even = len(marks) & ~7
        eights = np.flatnonzero(marks[:even].view(np.uint64))
        inside = np.flatnonzero(marks[:even].reshape(-1, 8)[eights])
        return np.concatenate([8 * eights[inside >> 3] + (inside & 7), even + np.flatnonzero(marks[even:])])

    def tiled(
        qv: np.ndarray, qids: np.ndarray | None, ids: np.ndarray, cv: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for many rows: the k-th distance among the rows seen bounds what the next rows may have.

        Products are of single precision; whatever lies within their error of the bound is summed exactly. Rows
        come in random order and in stretches that double, so a query keeps few candidates. Queries that keep
        many, as of vectors that lie close together but far from zero, are left to `plain`.
        """
        order = np.random.default_rng(7).permutation(len(ids))
        order[:SAMPLE_ROWS] = order[:SAMPLE_ROWS][np.argsort(ids[order[:SAMPLE_ROWS]], kind="stable")]
        ids, cv = ids[order], cv[order]
        qn, cn = (qv * qv).sum(axis=1), (cv * cv).sum(axis=1)
        left = np.empty((len(qv), qv.shape[1] + 1), np.float32)
        left[:, :-1], left[:, -1] = -2.0 * qv, 1.0
        right = np.empty((len(cv), cv.shape[1] + 1), np.float32)
        right[:, :-1], right[:, -1] = cv, cn
        slack = (qv.shape[1] + 16) * 2.0**-22 * (qn + cn.max()) + 1e-30
        products, marks = np.empty(QUERY_ROWS * TILE_ROWS, np.float32), np.empty(QUERY_ROWS * TILE_ROWS, bool)
        firsts = ids[:SAMPLE_ROWS]
        heads = np.flatnonzero(np.r_[True, firsts[1:] != firsts[:-1]])
        found = []
        for lo in range(0, len(qv), QUERY_ROWS):
            part = slice(lo, min(lo + QUERY_ROWS, len(qv)))
            size = part.stop - lo
            approx = left[part] @ right[: len(firsts)].T + qn[part, None]
            if qids is not None:
                approx[qids[part, None] == firsts[None, :]] = np.inf
            nearest = approx if len(heads) == len(firsts) else np.minimum.reduceat(approx, heads, axis=1)
            limit = np.full(size, np.inf)
            if nearest.shape[1] > k:
                limit = np.partition(nearest, k - 1, axis=1)[:, k - 1] + slack[part]
            kept, begin, width = None, 0, SAMPLE_ROWS
            while begin < len(ids):
                end = min(len(ids), begin + width)
                within = np.minimum(limit + slack[part] - qn[part], np.finfo(np.float32).max).astype(np.float32)[:, None]
                hit_rows, hit_cols, many = [], [], 0
                for a in range(begin, end, TILE_ROWS):
                    b = min(a + TILE_ROWS, end)
                    tile, shape = size * (b - a), (size, b - a)
                    np.matmul(left[part], right[a:b].T, out=products[:tile].reshape(shape))
                    np.less_equal(products[:tile].reshape(shape), within, out=marks[:tile].reshape(shape))
                    qi, ci = np.divmod(marked(marks[:tile]), b - a)
                    many += len(qi)
                    if many > size * (64 + 8 * k + (end - begin) // 32):
                        break
                    hit_rows.append(qi)
                    hit_cols.append(ci + a)
                if many > size * (64 + 8 * k + (end - begin) // 32):
                    kept = plain(qv[part], None if qids is None else qids[part], ids, cv)
                    break
                qi, ci = np.concatenate(hit_rows), np.concatenate(hit_cols)
                if qids is not None:
                    other = qids[lo + qi] != ids[ci]
                    qi, ci = qi[other], ci[other]
                exact = np.empty(len(qi))
                for a in range(0, len(qi), 200_000):
                    b = slice(a, a + 200_000)
                    exact[b] = distances(qv[lo + qi[b]], cv[ci[b]])
                new = (qi, ids[ci], exact)
                kept = k_nearest(*(new if kept is None else tuple(np.concatenate(x) for x in zip(kept, new))), k)
                full = np.bincount(kept[0], minlength=size) == k
                reach = np.zeros(size)
                np.maximum.at(reach, kept[0], kept[2])
                limit[full] = np.minimum(limit[full], reach[full])
                begin, width = end, end
            found.append((kept[0] + lo, kept[1], kept[2]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def best(
        qv: np.ndarray, qids: np.ndarray | None, ids: np.ndarray, cv: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if qv.shape[1] != cv.shape[1] and len(cv) and len(qv):
            raise ValueError(f"vectors differ in length: {qv.shape[1]} and {cv.shape[1]}")
        if len(ids) < BLOCK_ROWS or not len(qv):
            return plain(qv, qids, ids, cv)
        # single precision holds neither the squares of larger numbers nor null or infinite ones
        small = max(np.abs(qv).max(initial=0.0), np.abs(cv).max(initial=0.0)) < 1e15
        return (tiled if small else plain)(qv, qids, ids, cv)

    return best


def _once_function(k: int) -> Callable[..., Any]:
    """As `_top_k_function`, with vectors that several rows share compared once; ships with the task."""
    best, nearest = _top_k_function(k), _top_k_function(k + 1)

    def copies(ids: np.ndarray, cv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows in an order that puts equal vectors side by side, their ids ascending, and where each vector begins."""
        weights = np.random.default_rng(7).integers(1, 1 << 62, cv.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        bits, sums = np.ascontiguousarray(cv, np.float64).view(np.uint64), np.empty(len(cv), np.uint64)
        for lo in range(0, len(cv), 8192):
            part = bits[lo : lo + 8192]
            sums[lo : lo + 8192] = ((part ^ (part >> np.uint64(32))) * weights).sum(axis=1)  # low bits are mostly zero
        order = np.argsort(ids, kind="stable")
        order = order[np.argsort(sums[order], kind="stable")]
        same = np.flatnonzero(sums[order[1:]] == sums[order[:-1]])
        head = np.ones(len(ids), bool)
        for lo in range(0, len(same), 8192):
            at = same[lo : lo + 8192]
            head[at + 1] = (cv[order[at]] != cv[order[at + 1]]).any(axis=1)
        return order, np.flatnonzero(head)

    def once(
        qv: np.ndarray, qids: np.ndarray | None, ids: np.ndarray, cv: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors are numbered by their smallest id, so that the nearest k + 1 of them hold the k nearest ids: one of
        them may be the query's own alone, any vector after them has k others before each of its ids.
        """
        if len(ids) < BLOCK_ROWS or not len(qv) or len(np.unique(ids)) < len(ids):
            return best(qv, qids, ids, cv)
        order, first = copies(ids, cv)
        if 4 * len(first) > 3 * len(ids):
            return best(qv, qids, ids, cv)
        by_id = np.argsort(ids[order[first]], kind="stable")
        held = np.minimum(np.diff(np.r_[first, len(ids)]), k + 1)[by_id]
        first = first[by_id]
        rows, numbers, dist = nearest(qv, None, np.arange(len(first)), cv[order[first]])
        # vectors beyond k + 1 ids, and beyond all that are as far away as the last of these, are not needed
        before = np.cumsum(held[numbers]) - held[numbers]
        start = np.searchsorted(rows, rows, side="left")
        needed = np.zeros(len(qv))
        taken = before - before[start] <= k
        np.maximum.at(needed, rows[taken], dist[taken])
        taken |= dist <= needed[rows]
        rows, numbers, dist = rows[taken], numbers[taken], dist[taken]
        found = []
        for lo in range(0, len(qv), BLOCK_ROWS):
            part = slice(*np.searchsorted(rows, [lo, lo + BLOCK_ROWS]))
            sizes = held[numbers[part]]
            steps = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            r, d = np.repeat(rows[part], sizes), np.repeat(dist[part], sizes)
            i = ids[order[np.repeat(first[numbers[part]], sizes) + steps]]
            if qids is not None:
                other = qids[r] != i
                r, i, d = r[other], i[other], d[other]
            found.append(k_nearest(r, i, d, k))
        return tuple(np.concatenate(x) for x in zip(*found))

    return once


def k_nearest(
    rows: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest ids per row, every id once, ties to the smaller id."""
    order = np.lexsort((dist, ids, rows))
    rows, ids, dist = rows[order], ids[order], dist[order]
    fresh = np.ones(len(rows), dtype=bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])
    rows, ids, dist = rows[fresh], ids[fresh], dist[fresh]
    order = np.lexsort((ids, dist, rows))
    rows, ids, dist = rows[order], ids[order], dist[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    return rows[keep], ids[keep], dist[keep]


def _matrix_function() -> Callable[[Any], np.ndarray]:
    def matrix(column: Any) -> np.ndarray:
        """List column to a float64 matrix; vectors must agree in length."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if len(column) == 0:
            return np.zeros((0, 0))
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        lengths = np.diff(column.offsets.to_numpy())
        if (lengths != lengths[0]).any():
            raise ValueError("vectors differ in length")
        return flat.reshape(len(column), -1)

    return matrix


matrix_of = _matrix_function()


def rank_hits(hits: DataFrame, k: int, metric: str) -> DataFrame:
    """Final top k per query, every id once; tasks have sent k rows per query at most."""
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    # one shuffle serves the groups and the ranking
    once = hits.repartition("query_id").groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    top = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    d = F.sqrt("distance") if metric == "l2" else F.col("distance")
    return top.select("query_id", "rank", "id", d.alias("distance"))


def _hit_schema(queries: DataFrame, corpus: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", corpus.schema["id"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )


def _cell_function(tables: int, bits: int) -> Callable[[np.ndarray], np.ndarray]:
    """Cell numbers of vectors, one column per table: table number and sign bits."""

    def cells(v: np.ndarray) -> np.ndarray:
        i = np.arange(tables * bits * v.shape[1], dtype=np.int64)
        # same rule as plane_value
        planes = ((i * i * 31 + i * 7919 + 12345) % 65537 / 32768.0 - 1.0).reshape(
            tables * bits, v.shape[1]
        )
        side = (v @ planes.T > 0).astype(np.int64).reshape(len(v), tables, bits)
        return (side << np.arange(bits)).sum(axis=2) + np.arange(tables) * 2**bits

    return cells


def _broadcast_hits(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    exclude_self: bool,
    cells: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """Hits per corpus partition against a broadcast query matrix of checked size.

    A sample of bounded size gives every query a distance that its k-th hit does
    not exceed, so tasks send only rows within it. With `cells` only vectors that
    share a cell with a query are compared to it.
    """
    schema = _hit_schema(queries, corpus)
    matrix, best = _matrix_function(), _top_k_function(k)
    table = queries.select("query_id", "embedding").toArrow()
    asked, asked_v = table.column("query_id").to_numpy(), matrix(table.column("embedding"))
    bound = np.full(len(asked), np.inf)
    if cells is None and len(asked):
        some = corpus.select("id", "embedding").limit(SAMPLE_ROWS).toArrow()
        found = best(
            asked_v, asked if exclude_self else None, some.column("id").to_numpy(),
            matrix(some.column("embedding")),
        )
        full = np.bincount(found[0], minlength=len(asked)) == k
        np.maximum.at(reach := np.zeros(len(asked)), found[0], found[2])
        bound[full] = reach[full]
    shared = queries.sparkSession.sparkContext.broadcast((asked, asked_v, bound))

    def by_cell(qids, qv, q_cells, ids, cv):
        """Best of every cell that holds queries and rows of this batch."""
        c_cells = cells(cv)
        found = []
        for t in range(q_cells.shape[1]):
            q_order = np.argsort(q_cells[:, t], kind="stable")
            c_order = np.argsort(c_cells[:, t], kind="stable")
            q_sorted, c_sorted = q_cells[q_order, t], c_cells[c_order, t]
            for cell in np.intersect1d(q_sorted, c_sorted):
                qs = q_order[slice(*np.searchsorted(q_sorted, [cell, cell + 1]))]
                cs = c_order[slice(*np.searchsorted(c_sorted, [cell, cell + 1]))]
                r, i, d = best(qv[qs], qids[qs] if exclude_self else None, ids[cs], cv[cs])
                found.append((qs[r], i, d))
        if not found:
            return np.zeros(0, dtype=np.int64), ids[:0], np.zeros(0)
        return tuple(np.concatenate(parts) for parts in zip(*found))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Batches put together up to a block's size, as hits are merged once a block."""
        held = []
        for batch in batches:
            if batch.num_rows:
                ids, cv = batch.column("id").to_numpy(zero_copy_only=False), matrix(batch.column("embedding"))
                if held and (held[0][1].shape[1] != cv.shape[1] or sum(v.nbytes for _, v in held) + cv.nbytes > BLOCK_BYTES):
                    yield tuple(np.concatenate(x) for x in zip(*held))
                    held = []
                held.append((ids, cv))
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, qv, limits = shared.value
        q_cells = cells(qv) if cells is not None and len(qv) else None
        kept = None
        for ids, cv in blocks(batches) if len(qv) else ():
            if cells is None:
                new = best(qv, qids if exclude_self else None, ids, cv)
                new = tuple(x[new[2] <= limits[new[0]]] for x in new)
            else:
                new = by_cell(qids, qv, q_cells, ids, cv)
            both = new if kept is None else tuple(np.concatenate(p) for p in zip(kept, new))
            kept = k_nearest(*both, k)
        if kept is not None:
            rows, ids, dist = kept
            for lo in range(0, len(rows), 100_000):
                part = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qids[rows[part]]), pa.array(ids[part]), pa.array(dist[part])],
                    names=["query_id", "id", "distance"],
                )

    return corpus.select("id", "embedding").mapInArrow(run, schema)


def _block_hits(queries: DataFrame, corpus: DataFrame, k: int, dim: int, exclude_self: bool, asked: int, rows: int) -> DataFrame:
    """Hits of all pairs, in blocks: every part of the queries meets every part of the corpus once.

    There are as many parts as groups of bounded size need, and more where that leaves cores idle; the corpus gets
    fewer, as each of its parts sends k hits a query.
    """
    most, asked, rows = _group_rows(dim), max(1, asked), max(1, rows)
    c_parts = max(-(-rows // most), math.isqrt(MIN_GROUPS * rows // (2 * asked)), 1)
    q_parts = max(-(-asked // most), -(-MIN_GROUPS // c_parts))
    one = F.lit(0).alias("cell")  # a single cell, which the grid splits
    return _grid_hits(
        queries.select("*", one), corpus.select("*", one), k, dim, exclude_self,
        (q_parts, c_parts), min(MAX_CELLS, 2 * q_parts * c_parts), _dealt_by(corpus, rows, c_parts),
    )


def _dealt_by(corpus: DataFrame, rows: int, parts: int) -> str:
    """The column whose hash deals the corpus out: the vector, so that equal ones meet in a group and are compared once.

    Where copies of few vectors would make one of the parts too large, it is the id.
    """
    sizes = corpus.groupBy(F.pmod(F.xxhash64("embedding"), F.lit(parts)).alias("part")).count()
    largest = sizes.agg(F.max("count")).first()[0] or 0
    return "embedding" if largest <= 1.25 * rows / parts + BLOCK_ROWS else "id"


def _group_rows(dim: int) -> int:
    return max(1, GROUP_BYTES // (8 * dim))


def _grid_hits(
    queries: DataFrame, corpus: DataFrame, k: int, dim: int, exclude_self: bool,
    cut: tuple[int, int] | None = None, partitions: int | None = None, dealt_by: str = "id",
) -> DataFrame:
    """Hits where both sides share a `cell`, in groups of bounded size.

    A cell with many rows is split by the hash of the row ids into parts on
    both sides; every corpus part meets every query part. A cell that holds a
    third of all rows becomes many groups of the size of any other. `cut` gives
    the parts of the queries and of the corpus where they are known.
    """
    schema = _hit_schema(queries, corpus)
    matrix, best = _matrix_function(), _once_function(k)

    def parts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("cell").agg(F.ceil(F.count("*") / _group_rows(dim)).cast("int").alias(name))

    # one row per cell, and there are at most MAX_CELLS of them
    sizes = None if cut else F.broadcast(parts(corpus, "c_parts").join(parts(queries, "q_parts"), "cell"))

    def spread(df: DataFrame, key: str, by: str, own: str, other: str, own_no: str, other_no: str):
        sized = df.join(sizes, "cell") if cut is None else df.withColumn("q_parts", F.lit(cut[0])).withColumn("c_parts", F.lit(cut[1]))
        return (
            sized.withColumn(own_no, F.pmod(F.xxhash64(by), F.col(own)).cast("int"))
            .withColumn(other_no, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            .select("cell", "c_no", "q_no", key, "embedding")
        )

    # fresh column names on one side, since both may come from one table
    c = spread(corpus, "id", dealt_by, "c_parts", "q_parts", "c_no", "q_no").toDF(
        "c_cell", "c_part", "q_part", "id", "vec"
    )
    q = spread(queries, "query_id", "query_id", "q_parts", "c_parts", "q_no", "c_no")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table({"query_id": [], "id": [], "distance": []}).cast(target)
        qv, cv = matrix(left.column("embedding")), matrix(right.column("vec"))
        qids = left.column("query_id").to_numpy()
        rows, ids, dist = best(
            qv, qids if exclude_self else None, right.column("id").to_numpy(), cv
        )
        return pa.table(
            {"query_id": qids[rows], "id": ids, "distance": dist}
        ).cast(target)

    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    if partitions:
        # groups are small in bytes and long in time, so they are not to be put together
        q = q.repartition(partitions, "cell", "c_no", "q_no")
        c = c.repartition(partitions, "c_cell", "c_part", "q_part")
    by_c = c.groupBy("c_cell", "c_part", "q_part")
    return q.groupBy("cell", "c_no", "q_no").cogroup(by_c).applyInArrow(run, schema)


def _sides(queries: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """Both sides without null vectors, the number of queries and the dimension."""
    q = queries.where("embedding is not null").select("query_id", "embedding")
    c = corpus.where("embedding is not null").select("id", "embedding")
    size = q.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    return q, c, int(size["n"]), int(size["dim"] or 1)


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    metric: str = "l2sq",
    exclude_self: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Exact k nearest corpus rows of every query: query_id, rank, id, distance.

    `queries` holds ``(query_id, embedding)``, `corpus` ``(id, embedding)``.
    Distance is squared L2 (`l2sq`) or L2 (`l2`); ties go to the smaller id.
    `exclude_self` leaves out the hit whose id equals the query id.
    """
    if k <= 0:
        raise ValueError("k must be above zero")
    if metric not in ("l2sq", "l2"):
        raise ValueError("metric must be l2sq or l2")
    q, c, rows, dim = _sides(queries, corpus)
    if rows * _query_bytes(dim, k) <= broadcast_bytes:
        hits = _broadcast_hits(q, c, k, exclude_self)
    else:
        cells = _Cells(c, dim, k, exclude_self)
        if cells.share(q, rows) <= CELL_SHARE:
            hits = _cell_hits(cells, q, c)
        else:
            hits = _block_hits(q, c, k, dim, exclude_self, rows, int(cells.rows.sum()))
    return rank_hits(hits, k, metric)


def _place_function(pivots: np.ndarray) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Places vectors by the pivots; ships with the task without the sample that they were fitted on."""

    def place(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each vector and its distance to the pivot, summed term by term."""
        if vectors.shape[1] != pivots.shape[1]:
            raise ValueError(f"vectors differ in length: {vectors.shape[1]} and {pivots.shape[1]}")
        cell = centres.nearest(vectors, pivots)
        return cell, np.sqrt(((vectors - pivots[cell]) ** 2).sum(axis=1))

    return place


class _Cells:
    """Voronoi cells of a corpus and what they bound; ships with the tasks.

    Pivots are centres of a bounded sample. A query's own cell and its neighbours hold sample rows whose
    distances bound the k-th neighbour's; a cell is out of reach if it lies beyond that bound, by its own radii or
    by the plane between its pivot and the query's.
    """

    def __init__(self, corpus: DataFrame, dim: int, k: int, exclude_self: bool, pivots: int | None = None):
        self.k, self.exclude_self = k, exclude_self
        rows = corpus.count()
        # cells of about a group's size, at least enough of them to leave some out
        wanted = pivots or min(MAX_PIVOTS, max(int(rows**0.5), -(-rows * 8 * dim // GROUP_BYTES)))
        limit = min(centres.SAMPLE_ROWS, max(1, PIVOT_BYTES // (8 * dim)))
        self.ids, self.some = centres.sample(corpus, rows, min(limit, max(1, wanted) * centres.ROWS_PER_CENTRE))
        self.pivots = centres.fit(self.some, min(wanted, limit))
        own = centres.nearest(self.some, self.pivots)
        order = np.argsort(own, kind="stable")
        self.ids, self.some = self.ids[order], self.some[order]
        self.first = np.searchsorted(own[order], np.arange(len(self.pivots) + 1))
        self.apart = np.sqrt(centres.squared(self.pivots, self.pivots))
        size = len(self.pivots)
        self.rows, self.low, self.high = np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(size)
        self.per_group = _group_rows(dim)
        if size:
            found = self.placed(corpus).groupBy("cell").agg(
                F.count("*").alias("rows"), F.min("away").alias("low"), F.max("away").alias("high")
            )
            for r in found.collect():  # a row per pivot
                self.rows[r["cell"]], self.low[r["cell"]], self.high[r["cell"]] = r["rows"], r["low"], r["high"]

    def placed(self, corpus: DataFrame) -> DataFrame:
        """(cell, away) of each row of the corpus."""
        place = _place_function(self.pivots)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell, away = place(matrix_of(batch.column("embedding")))
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(away)], names=["cell", "away"])

        return corpus.select("embedding").mapInArrow(run, "cell int, away double")

    def bounds(self, ids: np.ndarray | None, vectors: np.ndarray, away: np.ndarray) -> np.ndarray:
        """A distance that each query's k-th neighbour does not exceed, from sample rows of near cells."""
        out = np.full(len(vectors), np.inf)
        near = np.argsort(away, axis=1, kind="stable")
        todo, cells = np.arange(len(vectors)), 1
        while len(todo) and cells <= 2 * len(self.pivots):
            short = []
            for i in todo.tolist():
                rows = np.concatenate([np.arange(self.first[c], self.first[c + 1]) for c in near[i, :cells]])
                if ids is not None:
                    rows = rows[self.ids[rows] != ids[i]]
                if len(rows) >= self.k:
                    d = np.sqrt(((self.some[rows] - vectors[i]) ** 2).sum(axis=1))
                    out[i] = np.partition(d, self.k - 1)[self.k - 1]
                else:
                    short.append(i)
            todo, cells = np.array(short, np.int64), 4 * cells
        return out

    def reached(self, ids: np.ndarray | None, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, cell) of all cells that hold a row within the query's bound, and the bounds."""
        away = np.array([np.sqrt(((v - self.pivots) ** 2).sum(axis=1)) for v in vectors])
        bound = self.bounds(ids, vectors, away)
        own = away.argmin(axis=1)
        at = np.arange(len(vectors))
        least = np.maximum(away - self.high, self.low - away)
        apart = self.apart[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (away**2 - away[at, own][:, None] ** 2) / (2 * apart)
        least = np.maximum(least, np.where(apart > 0, plane, 0.0))
        slack = 1e-9 * (1.0 + away + self.high)  # rounding
        rows, cells = np.nonzero((least <= bound[:, None] + slack) & (self.rows > 0))
        return rows, cells, bound

    def share(self, queries: DataFrame, asked: int) -> float:
        """Share of all distances that these cells leave to take, by a sample of the queries of bounded size."""
        total = int(self.rows.sum())
        ids, vectors = centres.sample(queries.withColumnRenamed("query_id", "id"), asked, PROBE_ROWS)
        if not total or not len(ids):
            return 0.0
        if vectors.shape[1] != self.pivots.shape[1]:
            raise ValueError(f"vectors differ in length: {vectors.shape[1]} and {self.pivots.shape[1]}")
        _, cells, _ = self.reached(ids if self.exclude_self else None, vectors)
        return float(self.rows[cells].sum()) / (total * len(ids))

    def routed(self, queries: DataFrame) -> DataFrame:
        """(query_id, embedding, bound, cell): a query once for each cell that it has to look at."""
        schema = T.StructType(
            [queries.schema["query_id"], queries.schema["embedding"], T.StructField("bound", T.DoubleType()), T.StructField("cell", T.IntegerType())]
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                step = max(1, centres.DISTANCES // max(1, len(self.pivots)))
                for i in range(0, batch.num_rows if len(self.pivots) else 0, step):
                    part = batch.slice(i, step)
                    vectors = matrix_of(part.column("embedding"))
                    if vectors.shape[1] != self.pivots.shape[1]:
                        raise ValueError(f"vectors differ in length: {vectors.shape[1]} and {self.pivots.shape[1]}")
                    ids = part.column("query_id").to_numpy(zero_copy_only=False) if self.exclude_self else None
                    rows, cells, bound = self.reached(ids, vectors)
                    taken = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [*taken.columns, pa.array(bound[rows]), pa.array(cells.astype(np.int32))], names=[*part.schema.names, "bound", "cell"]
                    )

        return queries.select("query_id", "embedding").mapInArrow(run, schema)


def _cell_hits(cells: _Cells, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Hits of every query in the cells it reaches, cell by cell.

    A cell above a group's size is split by the hash of the ids, and so are the queries that reach one cell; only
    where these exceed a group as well is a row of the cell sent more than once.
    """
    schema = _hit_schema(queries, corpus)
    best, part_rows = _top_k_function(cells.k), max(1, cells.per_group // GROUP_PARTS)
    routed = cells.routed(queries)
    visits = np.zeros(len(cells.pivots), np.int64)
    for r in routed.groupBy("cell").count().collect():  # a row per pivot
        visits[r["cell"]] = r["count"]
    c_parts, q_parts = (np.maximum(1, -(-n // cells.per_group)).astype(np.int32) for n in (cells.rows, visits))
    used = visits > 0
    placed, exclude_self = _place_function(cells.pivots), cells.exclude_self
    corpus_schema = T.StructType([corpus.schema["id"], corpus.schema["embedding"], *[T.StructField(c, T.IntegerType()) for c in ("c_cell", "n_own", "n_other")]])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(used):
                cell, _ = placed(matrix_of(batch.column("embedding")))
                keep = np.flatnonzero(used[cell])  # rows of a cell that no query reaches stay where they are
                at = cell[keep]
                arrays = [pa.array(x) for x in (at.astype(np.int32), c_parts[at], q_parts[at])]
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(keep)).columns, *arrays], names=["id", "embedding", "c_cell", "n_own", "n_other"])

    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    c = corpus.select("id", "embedding").mapInArrow(place, corpus_schema)
    c = c.select("c_cell", part("id", "n_own").alias("c_no"), every("n_other").alias("q_no"), "id", F.col("embedding").alias("vec"))
    sizes = queries.sparkSession.createDataFrame(
        [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(c_parts, q_parts, strict=True))], "cell int, n_c int, n_q int"
    )
    q = routed.join(F.broadcast(sizes), "cell")  # a row per pivot
    q = q.select("cell", every("n_c").alias("c_part"), part("query_id", "n_q").alias("q_part"), "query_id", "embedding", "bound")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table({"query_id": [], "id": [], "distance": []}).cast(target)
        qids, bounds = left.column("query_id").to_numpy(), left.column("bound").to_numpy()
        ids, cv = right.column("id").to_numpy(), matrix_of(right.column("vec"))
        found = []
        for i in range(0, len(qids), part_rows):  # copies of the queries are of a part of them
            part = slice(i, i + part_rows)
            qv = matrix_of(left.column("embedding").slice(i, part_rows))
            rows, near, dist = best(qv, qids[part] if exclude_self else None, ids, cv)
            keep = np.sqrt(dist) <= bounds[part][rows] * (1 + 1e-9) + 1e-9
            found.append((qids[part][rows[keep]], near[keep], dist[keep]))
        names = ("query_id", "id", "distance")
        return pa.table({n: np.concatenate(x) for n, x in zip(names, zip(*found), strict=True)}).cast(target)

    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    return q.groupBy("cell", "c_part", "q_part").cogroup(c.groupBy("c_cell", "c_no", "q_no")).applyInArrow(run, schema)


def knn_join(
    queries: DataFrame, corpus: DataFrame, k: int, metric: str = "l2sq", exclude_self: bool = False, pivots: int | None = None
) -> DataFrame:
    """`knn` for a query side of any size: an exact join over Voronoi cells.

    A row of the corpus is shuffled at most once, unless more queries reach its cell than a group holds; a query
    is shuffled once for each cell that its bound reaches. On vectors without clusters that is most cells.
    """
    if k <= 0:
        raise ValueError("k must be above zero")
    if metric not in ("l2sq", "l2"):
        raise ValueError("metric must be l2sq or l2")
    q, c, _, dim = _sides(queries, corpus)
    return rank_hits(_cell_hits(_Cells(c, dim, k, exclude_self, pivots), q, c), k, metric)


def knn_join_cost(queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool = False, pivots: int | None = None) -> DataFrame:
    """One row: rows of either side, rows that `knn_join` shuffles of them, distances it takes and their share of all."""
    q, c, asked, dim = _sides(queries, corpus)
    cells = _Cells(c, dim, k, exclude_self, pivots)
    total = int(cells.rows.sum())
    sent, visited, compared = 0, 0, 0
    for r in cells.routed(q).groupBy("cell").count().collect():  # a row per pivot
        rows, visits = int(cells.rows[r["cell"]]), r["count"]
        sent += rows * -(-visits // cells.per_group)
        visited += visits * -(-rows // cells.per_group)
        compared += rows * visits
    share = compared / (asked * total) if asked * total else None
    names = "queries long, corpus_rows long, corpus_rows_sent long, query_rows_sent long, comparisons long, share double"
    return queries.sparkSession.createDataFrame([(asked, total, sent, visited, compared, share)], names)


def _query_bytes(dim: int, k: int) -> int:
    """What a task holds for one query: its vector, its id and its k hits."""
    return 8 * dim + 16 + 24 * k


def plane_value(index: Column) -> Column:
    """Coordinate of the fixed hyperplanes by running number, within -1 and 1."""
    i = index.cast("bigint")
    return (i * i * 31 + i * 7919 + 12345) % 65537 / F.lit(32768.0) - F.lit(1.0)


def lsh_cells(df: DataFrame, tables: int, bits: int) -> DataFrame:
    """One row per table: `cell` holds the table number and the sign bits.

    The sides of `bits` fixed hyperplanes per table make the bits.
    """
    _check_cells(tables, bits)
    schema = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType())])
    matrix, cells = _matrix_function(), _cell_function(tables, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            found = cells(matrix(batch.column("embedding"))).astype(np.int32)
            for t in range(tables):
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(found[:, t])],
                    names=[*batch.schema.names, "cell"],
                )

    return df.mapInArrow(run, schema)


def _check_cells(tables: int, bits: int) -> None:
    if tables <= 0 or bits <= 0 or tables * 2**bits > MAX_CELLS:
        raise ValueError("tables * 2^bits must be between 1 and 65536")


def knn_lsh(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    tables: int = 16,
    bits: int = 4,
    metric: str = "l2sq",
    exclude_self: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Approximate neighbours: exact ranking among rows that share a cell.

    Rows share a cell if they lie on the same side of every plane of at least
    one table. More tables find more, more bits look at less. Queries of a
    checked size are broadcast and the corpus stays where it is; a larger query
    side meets the corpus cell by cell in groups of bounded size.
    """
    _check_cells(tables, bits)
    q, c, rows, dim = _sides(queries, corpus)
    if rows * _query_bytes(dim, k) <= broadcast_bytes:
        hits = _broadcast_hits(q, c, k, exclude_self, _cell_function(tables, bits))
    else:
        sides = lsh_cells(q, tables, bits), lsh_cells(c, tables, bits)
        hits = _grid_hits(*sides, k, dim, exclude_self)
    return rank_hits(hits, k, metric)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that were found: hits, expected, recall."""
    pairs = exact.select("query_id", "id").join(
        found.select("query_id", "id", F.lit(1).alias("got")), ["query_id", "id"], "left"
    )
    return pairs.agg(
        F.count("got").alias("hits"),
        F.count("*").alias("expected"),
        F.try_divide(F.count("got"), F.count("*")).alias("recall"),
    )


def enriched_text(df: DataFrame) -> Column:
    """Text that is encoded for a chunk joined with its document."""
    return F.concat(
        F.lit("Software: "), F.col("nome_software"), F.lit(" | Tópico: "), F.col("hierarquia"),
        F.lit(" - "), F.col("titulo"), F.lit("\nConteúdo: "), F.col("conteudo_texto"),
    )


def vector_id(source_path: Column, chunk: Column, sub: Column, block: Column | None = None) -> Column:
    """Id of a chunk by its position, independent of its text.

    `block` tells the chunks of later blocks of a file apart; null for the first.
    """
    key = F.concat_ws(
        "|", source_path, *([] if block is None else [block]),
        F.concat(F.lit("chunk_"), chunk.cast("string")), F.concat(F.lit("sub_"), sub.cast("string")),
    )
    return F.concat(F.lit("id_"), F.sha2(key, 256))


def vector_rows(kb: DataFrame, backend: str, model: dict[str, str]) -> DataFrame:
    """Rows for the vector table: id, document text and metadata of 13 + 4 keys."""
    meta = F.struct(
        F.col("id").alias("sqlite_id"),
        F.col("nome_software").alias("software"),
        "source_path", "chunk_ordem", "subchunk_ordem", "subchunk_total", "hierarquia", "titulo",
        "arquivo_hash", "arquivo_ingestao_em", "conteudo_hash", "conteudo_ingestao_em",
        F.lit(backend).alias("embedding_backend"),
        *[F.lit(v).alias(name) for name, v in model.items()],
    )
    return kb.select(
        vector_id(
            F.col("source_path"), F.col("chunk_ordem"), F.col("subchunk_ordem"),
            block_label() if "block_no" in kb.columns else None,
        ).alias("id"),
        enriched_text(kb).alias("document"),
        meta.alias("metadata"),
    )


def hits_with_payload(
    hits: DataFrame, index: DataFrame, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Ranked hits with document and the metadata fields lifted to columns.

    The ids of stored hits, if their size allows, are broadcast to the index, so
    that only the rows that were hit are shuffled with their texts.
    """
    wanted = hits.select("id").distinct()
    if hits.count() * ID_BYTES <= broadcast_bytes:
        wanted = F.broadcast(wanted)
    h, i = hits.alias("h"), index.join(wanted, "id", "left_semi").alias("i")
    return h.join(i, F.col("h.id") == F.col("i.id"), "left").select(
        "h.query_id", "h.rank", "h.id", "h.distance", "i.document", "i.metadata",
        F.col("i.metadata.software").alias("software"),
        F.col("i.metadata.hierarquia").alias("hierarquia"),
        F.col("i.metadata.titulo").alias("titulo"),
        F.col("i.metadata.source_path").alias("source_path"),
    )
