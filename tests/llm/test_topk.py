import math
import random

import numpy as np
from pyspark.sql import functions as F

from docspark.llm import topk
from docspark.session import stage


def plain(rows, k):
    keep = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            keep[i] = [math.floor(64 * x) for x in v]
    out = []
    for q, a in keep.items():
        if q % 20 == 0:
            hits = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in keep.items() if i != q)
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(hits[:k], 1)]
    return sorted(out)


def run(spark, rows, **options):
    table = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    table = table.where(topk.valid(F.col("embedding"))).select("vec_id", topk.quantized(F.col("embedding")).alias("v"))
    return sorted(map(tuple, topk.search(table, F.col("vec_id") % 20 == 0, stage, **options).collect()))


def vectors(n, width=8, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.normal(size=width).astype(np.float32)]) for i in range(n)]


def test_search_matches_brute_force(spark):
    rows = vectors(700)
    rows += [(1000 + i, rows[40][1]) for i in range(60)] + [(2000, None), (2020, [1.0, None]), (2040, [math.nan] * 8), (2060, [math.inf] * 8)]
    rows += [(None, rows[1][1]), (3000, [0.5, 0.25]), (3020, []), rows[20], rows[20]]
    assert run(spark, rows, k=20) == plain(rows, 20)
    assert run(spark, rows, k=5, query_block=56, data_block=720) == plain(rows, 5)


def test_fewer_candidates_than_k_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (5, [1.0, 0.0]), (3, [0.0, 1.0])]
    assert run(spark, rows) == plain(rows, 20) and len(run(spark, rows)) == 6
    assert run(spark, [(0, [1.0])]) == [] and run(spark, []) == []


def clusters(rows, width=64, count=40, spread=0.1, seed=5):
    """Whole-number vectors around some centres, as the operator sees them."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(count, width))
    return np.floor(64 * (middle[rng.integers(0, count, rows)] + spread * rng.normal(size=(rows, width))))


def test_levels_nest_cover_and_separate():
    rng = np.random.default_rng(3)
    for points in (np.floor(100 * rng.normal(size=(900, 3))), clusters(700), np.ones((5, 2)), np.floor(9 * rng.normal(size=(300, 1)))):
        tree = topk.CoverTree(points, leaf=2)
        away = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
        counts = [c for _, c in tree.levels]
        assert counts == sorted(counts) and counts[0] == 1  # nesting: a level's centres begin with those above
        assert [s for s, _ in tree.levels] == list(range(tree.levels[0][0], tree.levels[0][0] - len(counts), -1))  # base 2
        assert away[tree.centres[0]].max() <= 2.0 ** tree.levels[0][0]
        for (scale, count), (_, above) in zip(tree.levels[1:], tree.levels, strict=False):
            chosen = tree.centres[:count]
            apart = away[np.ix_(chosen, chosen)] + np.diag([np.inf] * count)
            assert apart.min() > 2.0**scale  # separation
            assert away[chosen].min(axis=0).max() <= 2.0**scale
            for c in range(above, count):
                assert tree.parent[c] < above and away[tree.centres[c], tree.centres[tree.parent[c]]] <= 2.0 ** (scale + 1)  # covering


def test_nodes_hold_their_points():
    points = clusters(900, 5, 12)
    tree = topk.CoverTree(points)
    assert sorted(tree.order) == list(range(900))
    ordered = points[tree.order]
    waiting = [tree.root, topk._unpack(topk._pack(tree.root))]
    leaves = 0
    while waiting:
        node = waiting.pop()
        assert np.sqrt(((ordered[node.start : node.end] - node.center) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        if node.children:
            assert [c.start for c in node.children] == [node.start, *[c.end for c in node.children[:-1]]] and node.children[-1].end == node.end
            waiting += node.children
        else:
            leaves += 1
            assert (np.diff(tree.order[node.start : node.end]) > 0).all()
    assert leaves > 20


def searched(queries, data, ids, k, least=None):
    asked, tree = topk.CoverTree(queries, topk.QUERY_LEAF), topk.CoverTree(data)
    least = np.full(len(queries), -np.inf) if least is None else least
    best = topk.dual_search(asked.root, queries[asked.order], tree.root, data[tree.order], ids[tree.order], least, k)
    back = np.argsort(asked.order)
    return best.scores[back], best.ids[back], best.compared


def test_radii_prune_on_clustered_vectors():
    data = clusters(8000)
    queries = data[::20]
    scores, _, compared = searched(queries, data, np.arange(8000), 20)
    assert compared <= 0.3 * len(queries) * len(data)
    assert (scores == np.sort(queries @ data.T, axis=1)[:, ::-1][:, :20]).all()
    # scores known from elsewhere prune more
    _, _, fewer = searched(queries, data, np.arange(8000), 20, np.full(len(queries), 1e12))
    assert fewer == 0


def test_blocks_are_left_out_as_well(spark, monkeypatch):
    data = clusters(3000)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, v array<double>")
    scores = data @ data.T
    want = []
    for q in range(0, 3000, 50):
        order = sorted((-scores[q, i], i) for i in range(3000) if i != q)[:5]
        want += [(q, r + 1, i, int(-s)) for r, (s, i) in enumerate(order)]
    got = topk.search(rows, F.col("vec_id") % 50 == 0, stage, k=5, data_block=64 * 300, query_block=64 * 10)
    assert sorted(map(tuple, got.collect())) == want


def test_random_ids_break_ties():
    rng = random.Random(2)
    ids = np.array(sorted(rng.sample(range(10**6), 500)))
    _, found, _ = searched(np.ones((3, 2)), np.ones((500, 2)), ids, 7)
    assert (found == ids[:7]).all()


def test_ids_with_several_vectors_have_full_rankings(spark):
    rng = np.random.default_rng(6)
    rows = [(0, [9.0 + j, 9.0, 9.0]) for j in range(5)] + [(i, [float(x) for x in rng.integers(-9, 9, 3)]) for i in range(1, 30)]
    rows += [(40, [9.0, 9.0, 9.0])]  # shares a vector with id 0
    table = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = topk.search(table, F.col("vec_id") % 20 == 0, stage).collect()
    ranks = sorted(r["rank"] for r in got if r["query_id"] == 0)
    assert ranks == sorted(list(range(1, 21)) * 5) and all(r["vec_id"] != r["query_id"] for r in got)
    best = {}
    for i, v in rows:
        for j, w in rows:
            if i == 0 and j:
                best.setdefault(tuple(v), []).append((-sum(a * b for a, b in zip(v, w, strict=True)), j))
    want = sorted((r + 1, j, int(-s)) for scores in best.values() for r, (s, j) in enumerate(sorted(scores)[:20]))
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 0) == want
    assert sorted(r["rank"] for r in got if r["query_id"] == 40) == list(range(1, 21))
