import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import negatives
from docspark.session import stage


def plain(rows, every=100, positives=5, k=10):
    keep = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            keep[(i, label, tuple(math.floor(256 * x) for x in v))] = 1
    out = []
    for a, label, v in keep:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, other) for i, other, w in keep if i != a)
        for s, i, _ in [x for x in scored if x[2] == label][:positives]:
            window = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:k]
            out += [(a, i, rank, x[1], -s, -x[0]) for rank, x in enumerate(window, 1)]
    return sorted(out)


def run(spark, rows, **options):
    schema = "vec_id long, label int, embedding array<float>, anchor string, ab int"
    table = spark.createDataFrame([(*r, "x", 3) for r in rows], schema)
    table = table.select("vec_id", "label", negatives.quantized(F.col("embedding"), 256.0).alias("v"))
    return sorted(map(tuple, negatives.mine(table, F.col("vec_id") % 100 == 0, stage, **options).collect()))


def vectors(n, width=8, seed=1, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, width))
    out = []
    for i in range(n):
        label = int(rng.integers(0, 4))
        v = (centres[label] + rng.normal(size=width)) * scale
        out.append((i, label, [float(x) for x in v.astype(np.float32)]))
    return out


def test_matches_brute_force(spark):
    rows = vectors(900)
    rows += [(2000 + i, 1, rows[100][2]) for i in range(150)] + [(3000 + i, 2, rows[7][2]) for i in range(40)]  # many ties
    rows += [(5000, None, rows[1][2]), (5100, 1, None), (5200, 1, [1.0, None]), (5300, 2, [math.nan] * 8), (5400, 2, [math.inf] * 8), (None, 1, rows[1][2])]
    rows += [(6000, 1, [0.5, 0.25]), (6100, 0, []), rows[200], rows[200], (300, 3, rows[5][2])]
    want = plain(rows)
    assert want and run(spark, rows) == want
    assert run(spark, rows, block=700) == want
    assert run(spark, rows, positives=2, negatives=3) == plain(rows, positives=2, k=3)


def test_few_rows_negative_scores_and_empty(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [-1.0, 0.0]), (2, 2, [-0.5, 0.0]), (3, 2, [0.5, 0.0]), (100, 1, [0.0, 0.0]), (4, 2, [0.0, 1.0])]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == [] and run(spark, [(0, 1, [1.0])]) == []


@pytest.mark.parametrize("width,top", [(1, 300), (64, 300), (64, LIMIT := negatives.LIMIT), (1500, 5000), (3, LIMIT)])
def test_scores_are_exact(width, top):
    rng = np.random.default_rng(width)
    a, b = (rng.integers(-top, top + 1, (n, width)).astype(np.int32) for n in (7, 30))
    a[0], b[0], b[1] = top, top, -top
    bound = width * top * top
    primes = negatives.moduli(width, bound)
    assert np.prod([float(p) for p in primes]) > 2 * bound and len(set(primes)) == len(primes)
    got = negatives.scores(negatives.residues(a, primes), negatives.residues(b, primes), primes)
    want = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a]
    assert got.tolist() == want


def test_products_stay_below_the_limit_of_float32():
    for width in (1, 2, 64, 100, 1024, 5000):
        p = negatives.moduli(width, 1)[0]
        assert min(width, 1024) * (p // 2) ** 2 <= 1 << 23


def test_huge_components_are_held(spark):
    rows = [(0, 1, [1e30, 1.0]), (1, 1, [1e30, 2.0]), (2, 2, [1e29, 0.0]), (3, 2, [0.1, 0.1])]
    got = run(spark, rows)
    assert all(r[4] <= 2 * negatives.LIMIT**2 for r in got)


def test_best_keeps_the_leftmost_of_ties():
    values = np.array([[5, 7, 5, 7, 5], [1, 1, 1, 1, 1]])
    fits = np.array([[True] * 5, [False, True, True, False, True]])
    i, j = negatives.best(values, fits, 3)
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 0), (0, 1), (0, 3), (1, 1), (1, 2), (1, 4)]
