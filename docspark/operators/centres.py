"""Centres of vectors: a bounded sample, k-means on it, nearest centres of any vectors.

Searches that look at a part of the rows only deal the rows out by their nearest centre. Centres are fitted on
the driver from a sample of bounded size, which a hash draws from all rows; everything else is done where the
rows are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a sample, by default for each centre, and at most.
ROWS_PER_CENTRE = 64
SAMPLE_ROWS = 1 << 16
#: Distances that a step of `nearest` holds.
DISTANCES = 1 << 18
_ROUNDS = 10


def sample(rows: DataFrame, total: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of at most `wanted` of `total` rows (id, embedding), every id once.

    A hash of the row decides, so each row has the same chance. About a quarter more rows than wanted pass it;
    the driver gets `wanted` at most.
    """
    share = min(1.0, 1.25 * wanted / max(1, total))
    drawn = rows.where(F.pmod(F.xxhash64("id", "embedding"), F.lit(1 << 30)) < int(share * (1 << 30)))
    table = drawn.select("id", "embedding").limit(wanted).toArrow()
    ids = table.column("id").to_numpy()
    lists = table.column("embedding").to_pylist()
    if len({len(v) for v in lists}) > 1:
        raise ValueError("vectors differ in length")
    vectors = np.array(lists, np.float64).reshape(len(lists), len(lists[0]) if lists else 0)
    _, first = np.unique(ids, return_index=True) if len(ids) else (None, np.zeros(0, np.int64))
    return ids[first], vectors[first]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, by a matrix product."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T), 0.0)


def nearest(vectors: np.ndarray, centres: np.ndarray, step: int | None = None) -> np.ndarray:
    """Number of the nearest centre of each vector; DISTANCES are held at once, however many centres there are."""
    step = step or max(1, DISTANCES // max(1, len(centres)))
    found = [squared(vectors[i : i + step], centres).argmin(axis=1) for i in range(0, len(vectors), step)]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def fit(vectors: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """At most `count` centres by k-means: far vectors are likelier to be first centres; no two are equal."""
    rng = np.random.default_rng(seed)
    count = min(count, len(vectors))
    if count == 0:
        return vectors[:0]
    chosen = [int(rng.integers(len(vectors)))]
    away = squared(vectors, vectors[chosen])[:, 0]
    tiny = 1e-12 * max(1.0, float((vectors * vectors).sum(axis=1).max()))
    while len(chosen) < count and away.max() > tiny:
        weight = np.cumsum(np.where(away > tiny, away, 0.0))
        chosen.append(min(int(np.searchsorted(weight, rng.random() * weight[-1], side="right")), len(vectors) - 1))
        away = np.minimum(away, squared(vectors, vectors[chosen[-1:]])[:, 0])
    centres = vectors[chosen]
    for _ in range(_ROUNDS):
        owner = nearest(vectors, centres)
        size = np.bincount(owner, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, vectors)
        moved = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return np.unique(centres, axis=0)
