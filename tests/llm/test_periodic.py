import hashlib
import random
import zlib

import numpy as np
import pytest

from docspark.llm import periodic, queries
from tests.llm.brute import words
from tests.llm.texts import corpus, sentence


def plain_runs(w, least=12):
    """(start, length, period) of every run, by comparing all lags."""
    best = {}
    for q in range(1, len(w) // 2 + 1):
        start = 0
        for i in range(len(w) - q + 1):
            if i == len(w) - q or w[i] != w[i + q]:
                if i - start >= max(q, least - q):
                    best.setdefault((start, i + q), q)
                start = i + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def plain(doc_id, text):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = digest("".join(f"{s},{n},{q}\n" for s, n, q in runs))
    return (doc_id, len(runs), *longest, listed, digest(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def hashes(texts):
    """Word hashes of some texts, and the number of each word's text."""
    value = {}
    flat = [(value.setdefault((k, x), len(value)), k) for k, t in enumerate(texts) for x in t]
    draws = np.random.default_rng(1).integers(0, 1 << 63, max(1, len(value)), dtype=np.uint64)
    ids, owner = np.array(flat, np.int64).reshape(-1, 2).T
    return draws[ids], owner


def found(texts, **options):
    x, owner = hashes(texts)
    out = [[] for _ in texts]
    first = np.searchsorted(owner, np.arange(len(texts)))
    for s, e, q in periodic.find_runs(x, owner, **options).tolist():
        out[owner[s]].append((s - int(first[owner[s]]), e - s, q))
    return out


@pytest.mark.parametrize("short", [4, 8, 32])
def test_runs_match_all_lags(short):
    """Texts of few words are full of runs inside runs; small scales meet every rule."""
    rng = random.Random(short)
    for _ in range(60):
        texts = [[rng.choice("ab" if rng.random() < 0.7 else "abcd") for _ in range(rng.randrange(0, 160))] for _ in range(3)]
        for t in texts:
            if t and rng.random() < 0.6:
                a, p = rng.randrange(len(t)), rng.randrange(1, 40)
                t[a:] = [t[a + (i - a) % p] for i in range(a, len(t))]
        assert found(texts, short=short) == [plain_runs(t) for t in texts]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_periods_inside_periods():
    texts = [list(fibonacci(400)), ["a"] * 300, list(("ab" * 30 + "a") * 6), list("ab" * 40 + "a" + "ab" * 40 + "a"), [], ["x"]]
    texts += [list((("ab" * 20 + "c") * 3 + "d") * 3), list("a" * 90 + "b" + "a" * 90 + "b" + "a" * 50)]
    thue = "a"
    while len(thue) < 4096:
        thue += thue.translate(str.maketrans("ab", "ba"))
    texts.append(list(thue[:512]))
    for short in (4, 16, 32):
        assert found(texts, short=short) == [plain_runs(t) for t in texts]
    assert found([list(thue)]) == found([list(thue)], short=1024)  # equal sums of different windows are sorted out


def test_long_periods_in_prose():
    rng = random.Random(3)
    texts = []
    for p in (1, 5, 11, 31, 32, 33, 63, 64, 100, 129, 400):
        block = sentence(rng, p).split()
        texts.append(sentence(rng, 50).split() + (block * (12 + 2))[: max(12, 2 * p) + rng.randrange(3)] + sentence(rng, 40).split())
    assert found(texts) == [plain_runs(t) for t in texts]
    assert sum(map(len, found(texts))) >= 11


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def table(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, n_runs string, runs string, words long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_matches_plain_python(spark, tmp_path):
    rng = random.Random(9)
    texts = corpus()
    texts |= {1000 + i: sentence(rng, rng.randrange(1, 300)) for i in range(60)}  # a tenth gets a period
    rows = [(i, t, "n", "r", 1) for i, t in texts.items()] + [(None, texts[3], "n", "r", 1), (7, texts[7], "n", "r", 1)]
    got = queries.QUERIES["op11_periodic_runs"](spark, table(spark, tmp_path, rows)).select(*COLUMNS)
    assert rows_of(got) == sorted([plain(r[0], r[1]) for r in rows], key=str)
    assert sum(r[1] > 0 for r in got.collect()) > 10


def test_empty_table(spark, tmp_path):
    assert queries.QUERIES["op11_periodic_runs"](spark, table(spark, tmp_path, [])).count() == 0


def test_collapsed_text_and_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "start " + "x y z\n" * 6 + "end"), (2, None)], "doc_id long, text string")
    frame = periodic.find(docs)
    assert "Exchange" not in frame._jdf.queryExecution().toString()
    got = {r["doc_id"]: r for r in frame.collect()}
    assert got[1]["collapsed"] == "start x y z end" and [tuple(r) for r in got[1]["runs"]] == [(1, 18, 3)]
    assert (got[2]["n_words"], got[2]["runs"], got[2]["collapsed"]) == (0, [], "")
