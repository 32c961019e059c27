"""Exact top-k search by inner product: a dual-tree search over cover trees.

A cover tree has levels of centres at scales 2^i. Each level holds the one above (nesting), every centre of a
level lies within 2^(i+1) of its parent in the level above (covering), and any two centres of a level lie more
than 2^i apart (separation). `CoverTree` takes centres farthest first, which gives all three, and stops before a
level that would hold more than a LEAF-th of the points: on vectors that all lie equally far apart, smaller nodes
would only be single points. Coordinates are whole numbers, so that squared distances and products are exact.

The tree over the data is built once and stored in parts: its top centres come from a bounded sample, every row
belongs to the nearest of them, and each becomes one subtree, or several of bounded size where it holds many rows.
Distinct query vectors are grouped by the top centre with the highest product. Each group first searches that
centre's subtrees; with the k-th scores found there it goes on to the centres whose bound can still beat them.
A task builds a tree over its queries and walks pairs of nodes, best bound first: for centres p, q and radii r, s
no product exceeds p.q + |p| s + |q| r + r s, and a pair whose bound is below the worst k-th score of the group's
queries is left out. Leaves are compared by a matrix product.

Equal vectors need one search: a query vector is searched once for k + 1 ids, which every row with that
vector shares but for its own id, and of equal candidates the k + 1 smallest ids suffice. A query whose id has
other vectors as well is searched on its own, with all rows of its id left out.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter ones
count as padded by zeros; rows with a null id take no part; rows repeated with id and vector count once;
rows of one id with different vectors have a ranking each, without any row of that id; ties go to the smaller
id; fewer candidates than k give all; very long vectors make subtrees of fewer rows; empty tables give an
empty result; other columns are not read. Scores are exact while they stay below 2^53.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 20
#: Numbers of a block of queries (4,096 of 64) and of a subtree's rows (8,192 of 64).
QUERY_BLOCK = 1 << 18
DATA_BLOCK = 1 << 19
#: Points per leaf on average, at least; a group of queries is only as good as its worst.
LEAF = 16
QUERY_LEAF = 4
#: Top centres at most, per subtree wanted, and the rows they are chosen from.
MAX_CENTRES = 1024
_CENTRES_PER_BLOCK = 4
_SAMPLE_ROWS = 1 << 14
#: Scores held at once.
_CELLS = 1 << 21

_KEY = ["h1", "h2", "own", "masked"]


def quantized(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of every component as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))


def valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _squared(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    gap = points - center
    return np.einsum("ij,ij->i", gap, gap)


class Node:
    """A centre, the slice of the tree's points below it, and the largest distance to one of them."""

    __slots__ = ("start", "end", "center", "radius", "norm", "children")

    def __init__(self, start: int, end: int, center: np.ndarray, radius: float):
        self.start, self.end, self.center, self.radius = start, end, center, radius
        self.norm = float(np.sqrt(center @ center))
        self.children: list[Node] = []


class CoverTree:
    """Levels of centres over some points.

    `levels` has (scale, number of centres) from the top: the centres of a level are the first of `centres`.
    `parent` has each centre's parent in the level above its first. `order` lists the points so that those below
    any node are one slice; points of a leaf ascend.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        n = len(points)
        nearest, owner = _squared(points, points[0]), np.zeros(n, np.int64)
        self.centres, self.parent = [0], [-1]
        scale = int(np.ceil(np.log2(max(1.0, np.sqrt(nearest.max())))))
        while 4.0**scale < nearest.max():
            scale += 1
        self.levels = [(scale, 1)]
        while nearest.max() > 0:
            scale -= 1
            before, above, above_owner = len(self.centres), nearest.copy(), owner.copy()
            while len(self.centres) <= max(1, n // leaf) and nearest.max() > 4.0**scale:
                far = int(nearest.argmax())
                away = _squared(points, points[far])
                closer = away < nearest
                owner[closer] = len(self.centres)
                nearest = np.minimum(nearest, away)
                self.centres.append(far)
                self.parent.append(int(above_owner[far]))
            if nearest.max() > 4.0**scale:  # too many centres: the level above is the last
                del self.centres[before:], self.parent[before:]
                nearest, owner = above, above_owner
                break
            self.levels.append((scale, len(self.centres)))
        self.owner = owner
        self.order, self.root = self._nodes()

    def _nodes(self) -> tuple[np.ndarray, Node]:
        counts = [c for _, c in self.levels]
        born = np.searchsorted(counts, np.arange(len(self.centres)), side="right")  # first level that has the centre
        kids: dict[tuple[int, int], list[int]] = {}
        for c in range(1, len(self.centres)):
            kids.setdefault((self.parent[c], int(born[c])), []).append(c)
        by_leaf = np.argsort(self.owner, kind="stable")
        first = np.searchsorted(self.owner[by_leaf], np.arange(len(self.centres) + 1))
        order: list[np.ndarray] = []
        done = 0

        def grow(c: int, level: int) -> Node:
            nonlocal done
            while level < len(counts) and (c, level) not in kids:
                level += 1
            start, children = done, []
            if level < len(counts):
                children = [grow(x, level + 1) for x in (c, *kids[c, level])]
            else:
                order.append(by_leaf[first[c] : first[c + 1]])
                done += len(order[-1])
            center = self.points[self.centres[c]]
            below = order[-1] if not children else np.concatenate(order)[start:done]
            node = Node(start, done, center, float(np.sqrt(_squared(self.points[below], center).max(initial=0.0))))
            node.children = children
            return node

        root = grow(0, 1)
        return np.concatenate(order), root


def _pack(root: Node) -> np.ndarray:
    """Rows (start, end, radius, first child, number of children, centre ...) of all nodes, the root first."""
    nodes, rows = [root], []
    for node in nodes:  # grows as it goes
        rows.append([node.start, node.end, node.radius, len(nodes), len(node.children)])
        nodes.extend(node.children)
    return np.concatenate([np.array(rows, np.float64), np.array([x.center for x in nodes])], axis=1)


def _unpack(rows: np.ndarray) -> Node:
    nodes = [Node(int(r[0]), int(r[1]), r[5:], float(r[2])) for r in rows]
    for node, r in zip(nodes, rows, strict=True):
        node.children = nodes[int(r[3]) : int(r[3]) + int(r[4])]
    return nodes[0]


def k_best(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest values above -inf of each row, the leftmost of equal ones."""
    take = values > -np.inf
    if values.shape[1] > k:
        limit = np.partition(values, values.shape[1] - k, axis=1)[:, -k][:, None]
        above, level = values > limit, take & (values == limit)
        spare = k - above.sum(axis=1, keepdims=True)
        take = above | level
        crowded = np.flatnonzero(level.sum(axis=1) > spare[:, 0])
        take[crowded] = above[crowded] | (level[crowded] & (np.cumsum(level[crowded], axis=1) <= spare[crowded]))
    return np.nonzero(take)


class Best:
    """The k best (score, id) of each query so far; ties to smaller ids. `least` is a score already reached k times."""

    _NONE = np.iinfo(np.int64).max

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least, self.compared = k, least, 0
        self.scores = np.full((len(least), k), -np.inf)
        self.ids = np.full((len(least), k), self._NONE)

    def worst(self, queries: slice) -> float:
        return float(np.maximum(self.scores[queries, -1], self.least[queries]).min())

    def offer(self, at: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of some queries for ids, which ascend."""
        self.compared += scores.size
        bar = np.maximum(self.scores[at, -1], self.least[at])
        better = np.flatnonzero((scores >= bar[:, None]).any(axis=1))
        if not len(better):
            return
        i, j = k_best(scores[better], self.k)
        place = np.arange(len(i)) - np.searchsorted(i, i)
        width = int(place.max(initial=-1)) + 1
        rows = better + at.start
        all_scores = np.full((len(rows), self.k + width), -np.inf)
        all_ids = np.full((len(rows), self.k + width), self._NONE)
        all_scores[:, : self.k], all_ids[:, : self.k] = self.scores[rows], self.ids[rows]
        all_scores[i, self.k + place], all_ids[i, self.k + place] = scores[better][i, j], ids[j]
        order = np.lexsort((all_ids, -all_scores), axis=-1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(all_scores, order, axis=1)
        self.ids[rows] = np.take_along_axis(all_ids, order, axis=1)


def dual_search(
    query_root: Node, queries: np.ndarray, root: Node, data: np.ndarray, ids: np.ndarray, least: np.ndarray, k: int, own: np.ndarray | None = None
) -> Best:
    """The k best rows of data for every query, by a walk over pairs of nodes.

    Both sides lie in the order of their trees; `least` are scores that k rows elsewhere reach, `own` ids left out.
    """
    best = Best(least, k)

    def bound(q: Node, d: Node) -> float:
        b = float(q.center @ d.center) + q.norm * d.radius + d.norm * q.radius + q.radius * d.radius
        return b + 1e-9 * (abs(b) + q.norm * d.norm) + 1e-6  # rounding of the roots

    waiting = [(-np.inf, 0, query_root, root)]  # a heap: of all pairs the one with the best bound comes first
    met = count()
    while waiting:
        low, _, q, d = heapq.heappop(waiting)
        if -low < best.worst(slice(q.start, q.end)):
            continue
        if q.children or d.children:
            split_query = q.children and (not d.children or q.radius > d.radius)
            pairs = [(c, d) for c in q.children] if split_query else [(q, c) for c in d.children]
            for a, b in pairs:
                if (high := bound(a, b)) >= best.worst(slice(a.start, a.end)):
                    heapq.heappush(waiting, (-high, next(met) + 1, a, b))
            continue
        step = max(1, _CELLS // max(1, d.end - d.start))
        for i in range(q.start, q.end, step):
            at = slice(i, min(q.end, i + step))
            scores = queries[at] @ data[d.start : d.end].T
            if own is not None:
                scores[own[at][:, None] == ids[None, d.start : d.end]] = -np.inf
            best.offer(at, scores, ids[d.start : d.end])
    return best


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    out = np.zeros((len(lists), width))
    sizes = np.diff(lists.offsets.to_numpy())
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


def _batch_matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return _matrix(pa.chunked_array([batch.column("v")]), width)


def top_centres(points: np.ndarray, count: int) -> np.ndarray:
    """At most `count` points, each the farthest from those before: the top of a cover tree."""
    chosen, nearest = [0], _squared(points, points[0])
    while len(chosen) < count and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _squared(points, points[chosen[-1]]))
    return points[chosen]


def _subtree(width: int):
    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        points, ids = _matrix(table["v"], width), table["vec_id"].to_numpy()
        tree = CoverTree(points)
        names = ("top", "part", "ids", "points", "nodes")
        arrays = (ids[tree.order], points[tree.order], _pack(tree.root))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in arrays]], names=list(names))

    return build


def _searched(width: int, k: int):
    def search_block(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [*_KEY, "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.bool_() if c == "masked" else pa.int64()) for c in names], names=names)
        block = right.slice(0, 1).to_pylist()[0]
        ids = np.frombuffer(block["ids"], np.int64)
        data = np.frombuffer(block["points"], np.float64).reshape(-1, width)
        root = _unpack(np.frombuffer(block["nodes"], np.float64).reshape(-1, 5 + width))
        asked = _matrix(left["v"], width)
        tree = CoverTree(asked, QUERY_LEAF)
        left = left.take(pa.array(tree.order))
        masked = left["masked"].to_numpy()
        # no candidate has the id that stands for none
        own = np.where(masked, left["own"].to_numpy(), Best._NONE) if masked.any() else None
        best = dual_search(tree.root, asked[tree.order], root, data, ids, left["least"].to_numpy(), k, own)
        at, place = np.nonzero((best.ids != Best._NONE) & (best.scores >= best.least[:, None]))  # others are in no list of k
        found = left.select(_KEY).take(pa.array(at))
        columns = [pa.array(best.ids[at, place]), pa.array(best.scores[at, place].astype(np.int64))]
        return pa.table([*found.columns, *columns], names=names)

    return search_block


def search(vectors: DataFrame, is_query: Column, stored, k: int = K, query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of (vec_id, v) for every row where `is_query` holds.

    `stored` writes a table and reads it back. The driver gets counts, a bounded sample, and a radius and a size for
    each of MAX_CENTRES top centres at most.
    """
    rows = vectors.where(F.col("vec_id").isNotNull()).select("vec_id", "v").distinct()
    rows = stored(rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(7), "v")}))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    same = Window.partitionBy("h1", "h2").orderBy("vec_id")
    data = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).select("vec_id", "v", "h2")
    asked = rows.where(is_query)
    several = asked.groupBy("vec_id").count().where("count > 1").select("vec_id", F.lit(True).alias("_several"))
    asked = asked.join(several, "vec_id", "left").withColumn("masked", F.coalesce("_several", F.lit(False)))
    asked = stored(asked.withColumn("own", F.when(F.col("masked"), F.col("vec_id")).otherwise(0)).drop("_several"))
    # the rows of one key are alike
    queries = asked.withColumn("n", F.row_number().over(Window.partitionBy(*_KEY).orderBy("vec_id"))).where("n = 1").select(*_KEY, "v")

    total = data.count()
    if not total:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    per_block = max(1, data_block // width)
    wanted = min(MAX_CENTRES, _CENTRES_PER_BLOCK * -(-total // per_block)) if total > per_block else 1
    share = min(1.0, 2 * _SAMPLE_ROWS / total)
    some = data.where(F.pmod("h2", F.lit(1 << 30)) <= int(share * (1 << 30))).select("vec_id", "v").limit(_SAMPLE_ROWS).toArrow()
    tops = top_centres(_matrix(some["v"], width), wanted) if some.num_rows else np.zeros((1, width))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = _batch_matrix(batch, width)
                away = np.stack([_squared(points, c) for c in tops])
                top = away.argmin(axis=0)
                arrays = [pa.array(top.astype(np.int32)), pa.array(np.sqrt(away[top, np.arange(len(top))]))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, "top", "away"])

    placed = stored(data.mapInArrow(nearest, "vec_id long, v array<double>, h2 long, top int, away double"))
    radius, parts = np.full(len(tops), -1.0), np.ones(len(tops), np.int64)
    for r in placed.groupBy("top").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["top"]], parts[r["top"]] = r["radius"], -(-r["n"] // per_block)
    sizes = F.broadcast(rows.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(parts)], "top int, parts int"))
    part = F.pmod(F.xxhash64("vec_id", "h2"), F.col("parts")).cast("int").alias("part")
    subtrees = placed.join(sizes, "top").select("top", part, "vec_id", "v").groupBy("top", "part")
    blocks = stored(subtrees.applyInArrow(_subtree(width), "top int, part int, ids binary, points binary, nodes binary"))
    routed = "h1 long, h2 long, own long, masked boolean, v array<double>, least double, top int"

    def route(first: bool):
        """Each query for the centre it starts with, or for the others that its bound reaches."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                points, least = _batch_matrix(batch, width), batch.column("least").to_numpy()
                product = np.where(radius >= 0, points @ tops.T, -np.inf)  # centres without rows are out of reach
                norm = np.sqrt(np.einsum("ij,ij->i", points, points))[:, None]
                goes = np.zeros(product.shape, bool)
                goes[np.arange(len(points)), product.argmax(axis=1)] = True
                if not first:
                    high = product + norm * radius
                    goes = ~goes & (radius >= 0) & (high + 1e-9 * (np.abs(high) + norm * radius) + 1e-6 >= least[:, None])
                at, top = np.nonzero(goes)
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(top.astype(np.int32))], names=[*batch.schema.names, "top"])

        return run

    def found_by(sent: DataFrame) -> DataFrame:
        visits = sent.groupBy("top").agg(F.ceil(F.count(F.lit(1)) / max(1, query_block // width)).cast("int").alias("asks"))
        groups = F.broadcast(visits.join(sizes, "top"))  # a row per top centre
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = sent.join(groups, "top").select("top", every("parts").alias("part"), F.pmod("h1", "asks").cast("int").alias("ask"), *_KEY, "v", "least")
        right = blocks.join(groups.drop("parts"), "top").select(F.col("top").alias("of"), F.col("part").alias("no"), every("asks").alias("ask_no"), "ids", "points", "nodes")
        pairs = left.groupBy("top", "part", "ask").cogroup(right.groupBy("of", "no", "ask_no"))
        found = pairs.applyInArrow(_searched(width, k + 1), "h1 long, h2 long, own long, masked boolean, vec_id long, score long")
        return found

    ordered = Window.partitionBy(*_KEY).orderBy(F.desc("score"), "vec_id")
    start = queries.withColumn("least", F.lit(float("-inf"))).mapInArrow(route(True), routed)
    near = stored(found_by(start).withColumn("place", F.row_number().over(ordered)).where(F.col("place") <= k + 1))
    reached = near.where(F.col("place") == k + 1).select(*_KEY, F.col("score").cast("double").alias("least"))
    rest = queries.join(reached, _KEY, "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    far = found_by(stored(rest.select(*_KEY, "v", "least").mapInArrow(route(False), routed)))
    found = near.drop("place").unionByName(far)
    found = found.withColumn("place", F.row_number().over(ordered)).where(F.col("place") <= k + 1)
    hits = asked.select(F.col("vec_id").alias("query_id"), *_KEY).join(found, _KEY).where(F.col("vec_id") != F.col("query_id"))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "h1", "h2").orderBy("place")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
