import random
import time

import numpy as np

from docspark.llm import graph, jaccard
from docspark.session import stage
from tests.llm.brute import components, roots
from tests.llm.texts import corpus, sentence


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, class int, token string")
    return sorted(map(tuple, jaccard.join(docs, stage, **options).collect()), key=str)


def expect(texts):
    return sorted(((i, *v) for i, v in components(texts).items()), key=str)


def test_components_match_brute_force(spark):
    texts = corpus(seed=11)
    rng = random.Random(1)
    base = sentence(rng, 104).split()
    for k in range(60):  # a chain that drifts away from its first member
        base = list(base)
        base[rng.randrange(len(base))] = f"w{k}"
        texts[500 + k] = " ".join(base)
    for k in range(2, 12):  # around the threshold
        texts[700 + k] = " ".join(f"t{j}" for j in range(40)) + " " + " ".join(f"u{k}.{j}" for j in range(k))
    rows = list(texts.items())
    rng.shuffle(rows)
    assert run(spark, rows) == expect(texts)
    # lists of frequent shingles and blocks of cells change the work, not the result
    assert run(spark, rows, frequent=4, cell_shingles=300) == expect(texts)


def test_repeated_rows_and_null_ids(spark):
    text = sentence(random.Random(2), 50)
    got = run(spark, [(3, text), (3, text), (None, text), (9, text + " end"), (None, "alone is this text here"), (None, None)])
    assert got == sorted([(3, 46, 3), (3, 46, 3), (None, 46, 3), (9, 47, 3), (None, 1, None), (None, 0, None)], key=str)


def test_short_texts(spark):
    rows = [(1, "One two"), (2, "one\ttwo "), (3, "one two three"), (4, "É"), (5, "é"), (6, ""), (7, " ")]
    assert run(spark, rows) == expect(dict(rows))


def test_empty_table(spark):
    assert run(spark, []) == []


def test_one_document_of_each_group_stays(spark):
    texts = corpus(seed=11)
    rows = [(i, t, None) for i, t in texts.items()] + [(0, texts[0], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string")
    got = jaccard.representatives(docs, stage)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(i for i, (_, c) in components(texts).items() if i == c)


def test_rows_without_id_and_texts_under_one_id_are_decided_one_by_one(spark):
    rng = random.Random(12)
    a, b, c, d, e, f = (sentence(rng, 60) for _ in range(6))
    rows = [(None, a), (None, b), (None, b), (None, c + " end"), (4, c), (None, d), (None, d + " end")]
    rows += [(3, e), (7, e + " end"), (7, f), (7, f), (None, ""), (8, ""), (8, f + " end"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jaccard.representatives(docs, stage).collect()]
    either = [r for r in got if r in [(None, d), (None, d + " end")]]
    want = [(None, a), (None, b), (4, c), (3, e), (7, f), (None, ""), (8, ""), (8, None)]
    assert len(either) == 1 and sorted(got, key=str) == sorted(want + either, key=str)


def test_search_matches_brute_force():
    rng = random.Random(3)
    for _ in range(100):
        base = [rng.getrandbits(62) for _ in range(rng.randrange(1, 40))]
        sets = []
        for _ in range(rng.randrange(2, 25)):
            s = set(base)
            for _ in range(rng.randrange(6)):
                s = s - {rng.choice(sorted(s))} if len(s) > 1 and rng.random() < 0.5 else s | {rng.getrandbits(62)}
            sets.append(s)
        links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        got = jaccard.search([np.array(sorted(s), np.uint64) for s in sets])
        assert roots(range(len(sets)), got) == roots(range(len(sets)), links)
        sides = [rng.randrange(2) for _ in sets]
        got = jaccard.search([np.array(sorted(s), np.uint64) for s in sets], sides)
        across = [(a, b) for a, b in links if sides[a] != sides[b]]
        assert roots(range(len(sets)), got) == roots(range(len(sets)), across)


def test_divide_skip_finds_what_occurs_often_enough():
    rng = random.Random(6)
    for _ in range(300):
        lists = [sorted(rng.sample(range(60), rng.randrange(1, 25))) for _ in range(rng.randrange(1, 15))]
        t = rng.randrange(1, len(lists) + 1)
        count = {i: sum(i in one for one in lists) for i in range(60)}
        found, short = jaccard.divide_skip(lists, t, mu=rng.choice((0.0085, 0.2, 1.0)))
        assert all(found[i] == sum(i in one for one in lists[:short]) for i in found)
        assert {i for i, n in count.items() if n >= t} <= set(found)


def test_sketches_agree_on_linked_sets():
    rng = np.random.default_rng(1)
    lowest = 64
    for n in (4, 9, 50, 400):
        for _ in range(50):
            whole = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            part = whole[: -(-8 * n // 10)]
            s0, s1 = jaccard.sketches(np.r_[whole, part], np.array([n, len(part)]))
            lowest = min(lowest, int(jaccard.agreement(s0[0], s1[0], s0[1], s1[1])))
    assert lowest > jaccard._AGREE + 6


def test_components_of_paths_and_stars(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, 500 + i) for i in range(1, 30)] + [(7, 7), (3, 2), (2, 3)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), stage).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == roots(nodes, edges)


def test_long_lists_are_dealt_into_parts(spark):
    texts = corpus(seed=11)
    rng = random.Random(5)
    base = sentence(rng, 40).split()
    for k in range(300):  # near copies of one page
        base[rng.randrange(len(base))] = f"w{k}" if k % 3 else base[0]
        texts[2000 + k] = " ".join(base)
    rows = list(texts.items())
    assert run(spark, rows, list_classes=7) == run(spark, rows, agree=0) == expect(texts)


def test_lists_of_near_copies_take_time_in_proportion():
    rng = np.random.default_rng(3)
    ids, n = np.arange(20_000), rng.integers(95, 106, 20_000)
    s0, s1 = (np.full(20_000, x, np.uint64) for x in (3, 5))
    start = time.perf_counter()
    forest = jaccard._forest_of(ids, n, s0, s1)
    assert len(forest) == 19_999 and time.perf_counter() - start < 20
    half = s0.copy()
    half[::2] = ~half[::2]  # two groups that do not agree
    assert len(jaccard._forest_of(ids[:500], n[:500], half[:500], ~s1[:500] * (half[:500] != s0[:500]) + s1[:500] * (half[:500] == s0[:500]))) == 498


def test_forest_of_a_list_connects_what_all_pairs_connect():
    rng = np.random.default_rng(4)
    for _ in range(20):
        count = int(rng.integers(2, 200))
        n = rng.integers(20, 60, count)
        kinds = rng.integers(0, 4, count)
        marks = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
        s0 = s1 = marks[kinds]
        ids = rng.permutation(1000)[:count]
        fits = [(int(ids[i]), int(ids[j])) for i in range(count) for j in range(i)
                if 100 * min(n[i], n[j]) >= 80 * max(n[i], n[j]) and jaccard.agreement(s0[i], s1[i], s0[j], s1[j]) >= 30]
        found = jaccard._forest_of(ids, n, s0, s1)
        nodes = ids.tolist()
        assert roots(nodes, found) == roots(nodes, fits) and len(found) == len(nodes) - len(set(roots(nodes, fits).values()))


def test_cells_of_near_copies_are_searched_in_time():
    rng = np.random.default_rng(6)
    base = rng.choice(1 << 40, 200, replace=False)
    sets = []
    for k in range(3000):
        one = base.copy()
        one[rng.integers(0, 200, 5)] = (1 << 41) + 5 * k + np.arange(5)
        sets.append(np.unique(one))
    start = time.perf_counter()
    assert len(jaccard.search(sets)) == 2999 and time.perf_counter() - start < 15
