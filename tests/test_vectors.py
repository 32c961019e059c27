import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.operators import vectors


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[100:200] = x[7]  # a third of the rows are copies of one vector
    return x


@pytest.fixture(scope="module")
def frames(spark, points):
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<float>").repartition(5)
    return df.withColumnRenamed("id", "query_id"), df


def brute(points, k, skip_self):
    x = points.astype(np.float64)
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    if skip_self:
        np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :k]
    return order, np.take_along_axis(d, order, axis=1)


def ranked(df, k):
    rows = df.orderBy("query_id", "rank").collect()
    ids = np.array([r["id"] for r in rows]).reshape(-1, k)
    return ids, np.array([r["distance"] for r in rows]).reshape(-1, k)


@pytest.mark.parametrize("limit", [1 << 30, 0])
@pytest.mark.parametrize("skip_self", [True, False])
def test_exact_neighbours_equal_brute_force(frames, points, limit, skip_self):
    got = vectors.knn(*frames, 6, exclude_self=skip_self, broadcast_bytes=limit)
    ids, distances = ranked(got, 6)
    want_ids, want = brute(points, 6, skip_self)
    assert (ids == want_ids).all()
    assert np.allclose(distances, want)


def test_the_grid_splits_hot_groups_without_changing_the_result(frames, points, monkeypatch):
    monkeypatch.setattr(vectors, "GROUP_BYTES", 8 * 8 * 20)  # 20 rows per group part
    ids, _ = ranked(vectors.knn(*frames, 5, broadcast_bytes=0), 5)
    assert (ids == brute(points, 5, False)[0]).all()


def test_plain_l2_ranks_alike(frames):
    squared = vectors.knn(*frames, 4).withColumnRenamed("distance", "d2")
    both = vectors.knn(*frames, 4, metric="l2").join(squared, ["query_id", "rank", "id"])
    assert both.count() == 1200
    assert both.where(F.abs(F.col("distance") * F.col("distance") - F.col("d2")) > 1e-9).count() == 0


def test_approximate_search_is_exact_within_cells(frames):
    near = vectors.knn_lsh(*frames, 5, tables=12, bits=3)
    far = vectors.knn_lsh(*frames, 5, tables=12, bits=3, broadcast_bytes=0)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, far.collect()))
    found = vectors.recall(near, vectors.knn(*frames, 5)).first()
    assert found["expected"] == 1500 and found["recall"] > 0.8


def test_one_cell_is_exact_search(frames, points):
    x = np.abs(points)  # all on one side of nothing: a single table of one bit may still split
    assert len(x) == 300
    everything = vectors.knn_lsh(*frames, 5, tables=64, bits=1)
    assert vectors.recall(everything, vectors.knn(*frames, 5)).first()["recall"] > 0.99


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_an_id_counts_once_and_the_own_one_never(spark, limit):
    queries = spark.createDataFrame([(7, [0.0, 0.0])], "query_id bigint, embedding array<float>")
    rows = [(7, [0.0, 0.0]), (7, [0.1, 0.0]), (7, [0.0, 0.1]), (8, [1.0, 0.0]), (8, [3.0, 0.0]), (9, [2.0, 0.0])]
    for splits in (1, 3):
        corpus = spark.createDataFrame(rows, "id bigint, embedding array<float>").repartition(splits)
        own = vectors.knn(queries, corpus, 2, exclude_self=True, broadcast_bytes=limit).collect()
        assert [(r["rank"], r["id"], r["distance"]) for r in sorted(own)] == [(1, 8, 1.0), (2, 9, 4.0)]
        every = vectors.knn(queries, corpus, 3, broadcast_bytes=limit).collect()
        assert [r["id"] for r in sorted(every, key=lambda r: r["rank"])] == [7, 8, 9]


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_ragged_vectors_are_refused(spark, limit):
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id bigint, embedding array<float>")
    for rows in ([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0, 4.0])], [(1, [1.0, 2.0])]):
        corpus = spark.createDataFrame(rows, "id bigint, embedding array<float>").coalesce(1)
        with pytest.raises(Exception, match="differ in length"):
            vectors.knn(queries, corpus, 1, broadcast_bytes=limit).collect()


def test_bad_parameters(frames):
    for call in (
        lambda: vectors.knn(*frames, 0),
        lambda: vectors.knn(*frames, 3, metric="dot"),
        lambda: vectors.knn_lsh(*frames, 3, tables=1 << 12, bits=8),
        lambda: vectors.embed(frames[1], "id", lambda: None, 8, batch_size=0),
    ):
        with pytest.raises(ValueError):
            call()


def test_null_vectors_are_left_out(spark, frames):
    extra = spark.createDataFrame([(999, None)], frames[1].schema)
    got = vectors.knn(frames[0], frames[1].unionByName(extra), 3)
    assert got.where("id = 999").count() == 0


def test_encoder_is_made_once_per_task_and_sees_batches(spark):
    def make():
        def encode(texts):
            assert len(texts) <= 3
            return [[float(len(t)), 1.0] for t in texts]

        return encode

    df = spark.createDataFrame([(i, "x" * i) for i in range(10)], "id int, t string")
    out = vectors.embed(df, "t", make, 2, batch_size=3).orderBy("id").collect()
    assert [r["embedding"] for r in out] == [[float(i), 1.0] for i in range(10)]


def test_wrong_dimension_fails(spark):
    df = spark.createDataFrame([("a",)], "t string")
    with pytest.raises(Exception, match="expected 1 vectors of 3"):
        vectors.embed(df, "t", lambda: lambda ts: [[1.0]] * len(ts), 3).collect()


def test_ids_depend_on_position_only(many):
    ids = many(lambda c: vectors.vector_id(c, F.lit(1), F.lit(2)), ["a", "a", "b"])
    assert ids[0] == ids[1] != ids[2] and ids[0].startswith("id_") and len(ids[0]) == 67


def test_similarity_and_top_k(many):
    assert many(vectors.similarity, [0.0, 1.0, -3.0, None], "double") == [1.0, 0.5, 1.0, None]
    assert many(lambda c: vectors.effective_top_k(c, 7), [3, 0, None], "int") == [3, 7, 7]


def test_the_corpus_is_not_shuffled_for_a_small_query_side(frames):
    plan = vectors.knn(*frames, 3)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow"):]
    assert "hashpartitioning" not in below
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("shift", [0.0, 1e5])
@pytest.mark.parametrize("own", [True, False])
def test_a_large_block_is_searched_in_tiles_with_the_same_hits(shift, own):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(6000, 7)), 2) + shift
    x[1000:1400] = x[5]  # many equal vectors
    ids = np.arange(6000)
    ids[-50:] = ids[:50]  # some ids come twice
    q, asked = x[::11], ids[::11] if own else None
    rows, found, away = vectors._top_k_function(8)(q, asked, ids, x)
    for i in range(0, len(q), 7):
        d = ((x - q[i]) ** 2).sum(axis=1)
        nearest: dict[int, float] = {}
        for id_, distance in zip(ids.tolist(), d.tolist(), strict=True):
            if not own or id_ != asked[i]:
                nearest[id_] = min(distance, nearest.get(id_, np.inf))
        want = sorted((distance, id_) for id_, distance in nearest.items())[:8]
        assert list(zip(away[rows == i].tolist(), found[rows == i].tolist(), strict=True)) == want


def test_vectors_without_clusters_are_not_sent_to_every_cell(spark):
    """Queries that would look at most cells meet parts of the corpus instead, with about a row per part."""
    rng = np.random.default_rng(6)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 24)))], "id long, embedding array<double>")
    queries = table.withColumnRenamed("id", "query_id")
    cells = vectors._Cells(table, 24, 5, True)
    assert cells.share(queries, 3000) > vectors.CELL_SHARE and cells.routed(queries).count() > 20 * 3000
    hits = vectors._block_hits(queries, table, 5, 24, True, 3000, 3000)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and hits.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 5 * 7
    got, want = (vectors.knn(queries, table, 5, exclude_self=True, broadcast_bytes=b) for b in (0, 1 << 30))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("own", [True, False])
def test_equal_vectors_of_a_group_are_compared_once(own, monkeypatch):
    """Hits are those of all rows, with ties between copies and between vectors decided by the id."""
    rng = np.random.default_rng(8)
    some = rng.integers(-3, 4, size=(700, 3)).astype(float)  # many distances are equal
    cv = np.concatenate([some, some[rng.integers(0, 700, 3500)], np.repeat(some[:1], 300, axis=0)])
    ids = rng.permutation(len(cv)).astype(np.int64)
    qids, seen = ids[:400], []
    whole = vectors._top_k_function

    def counted(k):
        best = whole(k)
        return lambda *args: seen.append(len(args[2])) or best(*args)

    monkeypatch.setattr(vectors, "_top_k_function", counted)
    rows, found, away = vectors._once_function(8)(cv[:400], qids if own else None, ids, cv)
    assert max(seen) == len(np.unique(cv, axis=0)) < len(cv) / 10
    d = ((cv[:400, None, :] - cv[None, :, :]) ** 2).sum(axis=2)
    if own:
        d[qids[:, None] == ids[None, :]] = np.inf
    want = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :8]
    assert (rows.reshape(-1, 8) == np.arange(400)[:, None]).all()
    assert (found.reshape(-1, 8) == ids[want]).all() and (away.reshape(-1, 8) == np.take_along_axis(d, want, axis=1)).all()
    twice = np.concatenate([ids[:-50], ids[:50]])  # an id with two vectors counts once, with the nearer one
    got = vectors._once_function(8)(cv[:400], qids, twice, cv)
    assert all((a == b).all() for a, b in zip(got, whole(8)(cv[:400], qids, twice, cv), strict=True))


def test_copies_meet_in_a_part_unless_they_would_fill_it(spark):
    rows = spark.range(40_000).withColumn("embedding", F.array((F.col("id") % 8000).cast("double"), F.lit(1.0)))
    assert vectors._dealt_by(rows, 40_000, 4) == "embedding"
    same = rows.withColumn("embedding", F.array(F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("id").cast("double"))))
    assert vectors._dealt_by(same, 40_000, 4) == "id"
    near = rows.withColumnRenamed("id", "query_id").where("query_id < 90")
    hits = vectors._block_hits(near, rows, 3, 2, True, 90, 40_000)
    found = {(r["query_id"], r["id"]) for r in vectors.rank_hits(hits, 3, "l2sq").collect()}
    assert found == {(q, q + 8000 * i) for q in range(90) for i in (1, 2, 3)}
