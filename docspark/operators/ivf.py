"""Approximate neighbours: an inverted file with product-quantised residuals.

Every row of the corpus lies in the list of its nearest centre, as a code of a few bytes: the difference to the
centre is cut into parts, and each part is the number of the nearest of 256 trained parts. A query looks at the
lists of its nearest centres only, adds up distances from a table of its own distances to the trained parts, and
the rows that come out nearest are ranked by their true distances.

`train` fits on a bounded sample; `encode` covers every row without a shuffle, its result can be stored
partitioned by `list`; `search` reads the lists that some query probes, each in groups of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.operators import centres
from docspark.operators.vectors import matrix_of, rank_hits

#: Lists at most; by default twice the root of the number of rows.
MAX_LISTS = 1024
#: Numbers of one part of a residual.
PART_NUMBERS = 8
_VALUES = 256
#: Codes and queries of a group, and distances held at once.
GROUP_ROWS = 1 << 20
GROUP_QUERIES = 1 << 16
_CELLS = 1 << 21


@dataclass(frozen=True)
class Model:
    """Centres of the lists, and for each part of a residual its trained values."""

    centres: np.ndarray
    parts: tuple[np.ndarray, ...]

    def ends(self) -> np.ndarray:
        return np.cumsum([0, *[p.shape[1] for p in self.parts]])

    def codes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and code of each vector."""
        if vectors.shape[1] != self.centres.shape[1]:
            raise ValueError(f"expected vectors of {self.centres.shape[1]} numbers, got {vectors.shape[1]}")
        own = centres.nearest(vectors, self.centres)
        rest, ends = vectors - self.centres[own], self.ends()
        code = [centres.nearest(rest[:, a:b], p) for a, b, p in zip(ends, ends[1:], self.parts, strict=False)]
        return own, np.stack(code, axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray, which: int) -> np.ndarray:
        """Squared distances of the parts of each query, seen from one list's centre, to the trained values."""
        rest, ends = queries - self.centres[which], self.ends()
        out = np.full((len(queries), len(self.parts), _VALUES), np.inf)
        for j, p in enumerate(self.parts):
            out[:, j, : len(p)] = centres.squared(rest[:, ends[j] : ends[j + 1]], p)
        return out


def train(corpus: DataFrame, lists: int | None = None, part_numbers: int = PART_NUMBERS, sample_rows: int = centres.SAMPLE_ROWS, seed: int = 7) -> Model:
    """Fit centres and parts on at most `sample_rows` rows of (id, embedding), drawn by hash from all rows."""
    if part_numbers <= 0 or sample_rows <= 0 or (lists is not None and not 0 < lists <= MAX_LISTS):
        raise ValueError(f"part_numbers and sample_rows must be above zero, lists from 1 to {MAX_LISTS}")
    rows = corpus.where("embedding is not null")
    total = rows.count()
    if not total:
        raise ValueError("there is no vector to train on")
    lists = lists or min(MAX_LISTS, max(1, round(2 * total**0.5)))
    _, vectors = centres.sample(rows, total, min(sample_rows, max(_VALUES, lists) * centres.ROWS_PER_CENTRE))
    found = centres.fit(vectors, lists, seed)
    rest = vectors - found[centres.nearest(vectors, found)]
    cuts = range(0, vectors.shape[1], part_numbers)
    return Model(found, tuple(centres.fit(rest[:, a : a + part_numbers], _VALUES, seed) for a in cuts))


def encode(corpus: DataFrame, model: Model) -> DataFrame:
    """(list, id, code) of every row with a vector."""
    schema = T.StructType([T.StructField("list", T.IntegerType()), corpus.schema["id"], T.StructField("code", T.BinaryType())])
    shared = corpus.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, code = shared.value.codes(matrix_of(batch.column("embedding")))
                rows = pa.array([bytes(c) for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column("id"), rows], names=["list", "id", "code"])

    return corpus.where("embedding is not null").select("id", "embedding").mapInArrow(run, schema)


def probe(queries: DataFrame, model: Model, probes: int) -> DataFrame:
    """(list, query_id, embedding): every query once for each of its nearest lists."""
    schema = T.StructType([T.StructField("list", T.IntegerType()), queries.schema["query_id"], queries.schema["embedding"]])
    shared = queries.sparkSession.sparkContext.broadcast(model.centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(centres.squared(matrix_of(batch.column("embedding")), shared.value), axis=1, kind="stable")[:, :probes]
                for i in range(near.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(near[:, i].astype(np.int32)), *batch.columns], names=["list", "query_id", "embedding"])

    return queries.where("embedding is not null").select("query_id", "embedding").mapInArrow(run, schema)


def _checked(k: int, probes: int, rerank: int) -> None:
    if min(k, probes, rerank) <= 0:
        raise ValueError("k, probes and rerank must be above zero")


def candidates(queries: DataFrame, index: DataFrame, model: Model, wanted: int, probes: int, exclude_self: bool = False) -> DataFrame:
    """(query_id, id, estimate): the `wanted` rows of the probed lists whose codes are nearest to each query."""
    asked = probe(queries, model, probes)
    # one row per list that a query probes; parts keep a hot list, or one that most queries probe, in groups of bounded size
    sizes = index.groupBy("list").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("n_parts"))
    visits = asked.groupBy("list").agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("int").alias("n_asks"))
    groups = F.broadcast(sizes.join(visits, "list"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    parted = index.join(groups, "list").select(
        F.col("list").alias("of"), F.pmod(F.xxhash64("id"), "n_parts").cast("int").alias("no"), every("n_asks").alias("ask_no"), "id", "code"
    )
    asked = asked.join(groups, "list").select(
        "list", every("n_parts").alias("part"), F.pmod(F.xxhash64("query_id"), "n_asks").cast("int").alias("ask"), "query_id", "embedding"
    )
    fields = [queries.schema["query_id"], index.schema["id"], T.StructField("estimate", T.DoubleType())]
    schema = T.StructType(fields)
    shared = index.sparkSession.sparkContext.broadcast(model)

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        query_ids, ids, out = left.column("query_id"), right.column("id"), []
        codes = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(right.num_rows, -1)
        vectors = matrix_of(left.column("embedding")) if left.num_rows and right.num_rows else np.zeros((0, 0))
        own, row_ids = query_ids.to_numpy(), ids.to_numpy()
        step = max(1, _CELLS // max(1, len(codes)))
        for i in range(0, len(vectors), step):
            tables = shared.value.tables(vectors[i : i + step], key[0].as_py())
            estimate = np.zeros((len(tables), len(codes)))
            for j in range(tables.shape[1]):
                estimate += tables[:, j, :][:, codes[:, j]]
            if exclude_self:
                estimate[own[i : i + step, None] == row_ids[None, :]] = np.inf
            best = np.argpartition(estimate, wanted - 1, axis=1)[:, :wanted] if estimate.shape[1] > wanted else np.broadcast_to(np.arange(len(codes)), estimate.shape)
            at, col = np.nonzero(np.isfinite(np.take_along_axis(estimate, best, axis=1)))
            out.append((at + i, best[at, col], estimate[at, best[at, col]]))
        at, col, value = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 3
        return pa.table([query_ids.take(pa.array(at)), ids.take(pa.array(col)), pa.array(value.astype(float))], names=["query_id", "id", "estimate"])

    found = asked.groupBy("list", "part", "ask").cogroup(parted.groupBy("of", "no", "ask_no")).applyInArrow(run, schema)
    order = Window.partitionBy("query_id").orderBy("estimate", "id")
    return found.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= wanted).drop("_place")


def search(
    queries: DataFrame, corpus: DataFrame, index: DataFrame, model: Model, k: int, probes: int = 8, rerank: int = 10,
    metric: str = "l2sq", exclude_self: bool = False,
) -> DataFrame:
    """query_id, rank, id, distance: near rows of (id, embedding) for every query (query_id, embedding).

    `index` is `encode` of the corpus, computed or read back. `rerank * k` rows per query get their true
    distance. More probes and a larger `rerank` find more. Ties go to the smaller id; an id counts once.
    """
    _checked(k, probes, rerank)
    if metric not in ("l2sq", "l2"):
        raise ValueError("metric must be l2sq or l2")
    near = candidates(queries, index, model, rerank * k, probes, exclude_self).select("query_id", "id").distinct()
    rows = corpus.where("embedding is not null").select("id", F.col("embedding").alias("_row"))
    pairs = near.join(queries.where("embedding is not null").select("query_id", "embedding"), "query_id").join(rows, "id")
    gaps = F.zip_with("embedding", "_row", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    hits = pairs.select("query_id", "id", F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x).alias("distance"))
    return rank_hits(hits, k, metric)


def comparisons(queries: DataFrame, index: DataFrame, model: Model, k: int, probes: int = 8, rerank: int = 10) -> DataFrame:
    """One row: distances that `search` takes (to centres, to codes, for ranking), those of an exact search, their share."""
    _checked(k, probes, rerank)
    sizes = index.groupBy("list").agg(F.count("*").alias("rows"))
    # rows of a list that is not probed by a query count nothing; only probed rows can be ranked
    seen = probe(queries, model, probes).select("list", "query_id").join(sizes, "list", "left")
    asked = seen.groupBy("query_id").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("codes"))
    taken = asked.agg(
        F.sum(F.lit(len(model.centres)) + F.col("codes") + F.least("codes", F.lit(rerank * k))).alias("comparisons"),
        F.count("*").alias("queries"),
    )
    rows = taken.unionByName(sizes.agg(F.sum("rows").alias("corpus")), True)  # a single row each
    one = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("comparisons", "queries", "corpus")])
    exact = F.col("queries") * F.col("corpus")
    return one.select("comparisons", exact.alias("exact_comparisons"), F.try_divide("comparisons", exact).alias("share"))
