"""Searches that look at a part of the rows: the inverted file and the join over Voronoi cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.operators import centres, ivf, vectors


def frame(spark, points, ids=None, name="id"):
    rows = [(int(i), [float(x) for x in p]) for i, p in zip(range(len(points)) if ids is None else ids, points, strict=True)]
    return spark.createDataFrame(rows, f"{name} bigint, embedding array<float>").repartition(4)


def clustered(rows=2000, width=64, clusters=40, spread=0.1, seed=2):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(clusters, width))
    return (middle[rng.integers(0, clusters, rows)] + spread * rng.normal(size=(rows, width))).astype(np.float32)


@pytest.fixture(scope="module")
def points():
    return clustered()


@pytest.fixture(scope="module")
def corpus(spark, points):
    return frame(spark, points).cache()


def exact(points, queries, k, own=False):
    x = points.astype(np.float64)
    out = []
    for q in queries:
        d = ((x - x[q]) ** 2).sum(axis=1)
        if own:
            d[q] = np.inf
        order = np.lexsort((np.arange(len(x)), d))[:k]
        out += [(q, r + 1, int(i), round(float(d[i]), 9)) for r, i in enumerate(order)]
    return out


def rows_of(found):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["distance"], 9)) for r in found.collect())


# ---- join over Voronoi cells


@pytest.mark.parametrize("own", [True, False])
def test_join_equals_brute_force_and_leaves_most_pairs_out(corpus, points, own):
    queries = corpus.withColumnRenamed("id", "query_id")
    assert rows_of(vectors.knn_join(queries, corpus, 5, exclude_self=own)) == exact(points, range(len(points)), 5, own)
    cost = vectors.knn_join_cost(queries, corpus, 5, exclude_self=own).first()
    assert cost["corpus_rows_sent"] <= len(points) and cost["share"] < 0.15


def test_join_without_clusters_and_with_hot_cells(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 6)).astype(np.float32)
    x[200:450] = x[3]  # a third of the rows are one vector
    monkeypatch.setattr(vectors, "GROUP_BYTES", 8 * 6 * 60)  # 60 rows a group
    table = frame(spark, x)
    queries = table.withColumnRenamed("id", "query_id")
    for pivots in (None, 1, 30):
        assert rows_of(vectors.knn_join(queries, table, 4, exclude_self=True, pivots=pivots)) == exact(x, range(700), 4, True)


def test_join_counts_an_id_once(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 3)).astype(np.float32)
    ids = [i % 30 for i in range(120)]
    table = frame(spark, x, ids)
    queries = table.where("id < 5").withColumnRenamed("id", "query_id").dropDuplicates(["query_id"])
    got, want = (
        sorted(map(tuple, vectors.knn(queries, table, 7, exclude_self=True, broadcast_bytes=b).collect())) for b in (0, 1 << 30)
    )
    assert got == want and len(got) == 35


def test_fewer_rows_than_k_nulls_and_empty_sides(spark):
    table = frame(spark, np.eye(3))
    nothing = spark.createDataFrame([(9, None)], table.schema)
    queries = table.unionByName(nothing).withColumnRenamed("id", "query_id")
    assert len(rows_of(vectors.knn_join(queries, table.unionByName(nothing), 5))) == 9
    assert rows_of(vectors.knn_join(queries, nothing, 5)) == []
    assert rows_of(vectors.knn_join(queries.where("query_id = 9"), table, 5)) == []
    assert vectors.knn_join_cost(queries, nothing, 5).first()["share"] is None


def test_a_row_is_sent_once(corpus):
    """One generate node splits either side; the cogroup is the only exchange of the corpus."""
    queries = corpus.withColumnRenamed("id", "query_id")
    cost = vectors.knn_join_cost(queries, corpus, 10, exclude_self=True).first()
    assert cost["corpus_rows_sent"] <= cost["corpus_rows"] == 2000
    assert cost["query_rows_sent"] < 8 * cost["queries"]


# ---- inverted file


def test_recall_and_comparisons_on_clustered_vectors(corpus, points):
    model = ivf.train(corpus, lists=40)
    index = ivf.encode(corpus, model)
    queries = corpus.where(F.col("id") % 10 == 0).withColumnRenamed("id", "query_id")
    found = ivf.search(queries, corpus, index, model, 10, probes=2, rerank=5, exclude_self=True)
    want = exact(points, range(0, 2000, 10), 10, True)
    got = rows_of(found)
    recall = len({r[:1] + r[2:3] for r in got} & {r[:1] + r[2:3] for r in want}) / len(want)
    cost = ivf.comparisons(queries, index, model, 10, probes=2, rerank=5).first()
    assert recall >= 0.9 and cost["share"] <= 0.2 and cost["exact_comparisons"] == 200 * 2000
    distances = {(r[0], r[2]): r[3] for r in want}
    assert all(r[3] == distances[r[0], r[2]] for r in got if (r[0], r[2]) in distances)  # true distances


def test_all_lists_and_wide_reranking_are_exact(spark):
    x = np.random.default_rng(4).normal(size=(300, 20)).astype(np.float32)
    x[50:150] = x[7]
    table = frame(spark, x)
    queries = table.withColumnRenamed("id", "query_id")
    model = ivf.train(table, lists=12)
    found = ivf.search(queries, table, ivf.encode(table, model), model, 5, probes=12, rerank=60)
    assert rows_of(found) == exact(x, range(300), 5)


def test_hot_lists_and_hot_queries_are_split(spark, monkeypatch):
    x = clustered(400, 16, 4)
    x[:200] = x[0]
    table = frame(spark, x)
    queries = table.withColumnRenamed("id", "query_id")
    model = ivf.train(table, lists=6)
    index = ivf.encode(table, model)
    whole = rows_of(ivf.search(queries, table, index, model, 5, probes=6, rerank=80))
    monkeypatch.setattr(ivf, "GROUP_ROWS", 30)
    monkeypatch.setattr(ivf, "GROUP_QUERIES", 25)
    assert rows_of(ivf.search(queries, table, index, model, 5, probes=6, rerank=80)) == whole == exact(x, range(400), 5)


def test_codes_are_small_and_cover_every_row(spark, corpus):
    model = ivf.train(corpus, lists=16)
    index = ivf.encode(corpus, model)
    assert "Exchange hash" not in index._jdf.queryExecution().executedPlan().toString()
    rows = index.agg(F.count("*"), F.countDistinct("id"), F.max(F.length("code")), F.max("list")).first()
    assert tuple(rows)[:3] == (2000, 2000, 8) and rows[3] < 16
    again = ivf.train(corpus, lists=16)
    assert (again.centres == model.centres).all()


def test_a_stored_index_is_read_by_list(spark, corpus, tmp_path):
    model = ivf.train(corpus, lists=40)
    ivf.encode(corpus, model).write.partitionBy("list").parquet(f"{tmp_path}/index")
    stored = spark.read.parquet(f"{tmp_path}/index")
    queries = corpus.where("id < 3").withColumnRenamed("id", "query_id")
    near = ivf.search(queries, corpus, ivf.encode(corpus, model), model, 5, probes=2)
    assert rows_of(ivf.search(queries, corpus, stored, model, 5, probes=2)) == rows_of(near)
    plan = ivf.candidates(queries, stored, model, 50, 2)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_bad_parameters(spark, corpus):
    for call in (
        lambda: ivf.train(corpus, lists=0),
        lambda: ivf.train(corpus, part_numbers=0),
        lambda: ivf.train(corpus.where("id < 0")),
        lambda: ivf.search(corpus, corpus, corpus, None, 0),
        lambda: ivf.search(corpus, corpus, corpus, None, 3, metric="dot"),
        lambda: vectors.knn_join(corpus, corpus, 0),
    ):
        with pytest.raises(ValueError):
            call()


def test_centres():
    x = clustered(900, 8, 9, 0.01).astype(np.float64)
    found = centres.fit(x, 9)
    assert len(found) == 9 and np.sqrt(centres.squared(x, found).min(axis=1)).max() < 0.1
    assert len(centres.fit(np.ones((20, 3)), 5)) == 1 and len(centres.fit(np.zeros((0, 3)), 5)) == 0
    assert centres.nearest(x, x[:5]).tolist() == [int(((x[:5] - v) ** 2).sum(axis=1).argmin()) for v in x]


def test_nearest_holds_a_bounded_number_of_distances():
    import tracemalloc

    x = np.random.default_rng(3).normal(size=(10_000, 4))
    tracemalloc.start()
    found = centres.nearest(x, x[:1024])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20 and (found[:1024] == np.arange(1024)).all()


def test_places_ship_without_the_sample(spark):
    from pyspark import cloudpickle

    class Corpus:
        def select(self, *_):
            return self

        def mapInArrow(self, function, _):
            return function

    rows = frame(spark, clustered(rows=3000))
    cells = vectors._Cells(rows, 64, 3, True, pivots=8)
    assert len(cells.some) > 400 and len(cloudpickle.dumps(cells.placed(Corpus()))) < cells.some.nbytes / 4
