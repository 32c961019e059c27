import random

import numpy as np
import pyarrow as pa
import pytest

from docspark.operators import kb, postings
from docspark.session import stage

SCHEMA = "id string, nome_software string, source_path string, chunk_ordem int, subchunk_ordem int, block_no int, hierarquia string, titulo string, conteudo_texto string"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    words = "Wall door 100% under_score ÁRVORE árvore tool\\bar Topic topics ab a".split()
    data = []
    for i in range(400):
        title = None if i % 50 == 0 else " ".join(rng.choices(words, k=2))
        text = None if i % 70 == 0 else " ".join(rng.choices(words, k=rng.randrange(0, 12)))
        data.append((f"k{i}", "s", f"p{i % 9}", i, 1, 1, "h", title, text))
    return stage(spark.createDataFrame(data, SCHEMA))


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    postings.store(postings.number(rows, 60), path)
    return postings.read(rows.sparkSession, path)


TERMS = ("topic", "TOPIC", "wall door", "00%", "r_s", "under_sc", "t%r", "Á", "árv", "ÁRV", "ab", "", "%", "l\\b", "nothing like it", "_opic", "door%wall%tool")


@pytest.mark.parametrize("term", TERMS)
def test_the_index_finds_what_the_scan_finds(rows, index, term):
    want = [tuple(r) for r in kb.search_term(rows, term, 1000).collect()]
    assert [tuple(r) for r in postings.search_term(*index, term, 1000).collect()] == want
    assert [tuple(r) for r in postings.search_term(*index, term, 7).collect()] == want[:7]


def test_only_touched_lists_are_read(index):
    numbered, lists = index
    found = postings.candidates(lists, postings.term_grams("Topic"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram, [opi,pic,top])]" in plan and "Exchange SinglePartition" not in plan
    assert lists.where("gram in ('opi', 'pic', 'top')").count() * 4 < lists.count()
    assert found.count() < numbered.count()


def test_gaps_round_trip():
    rng = np.random.default_rng(1)
    for top in (1, 50, 10_000, 1 << 40):
        x = np.unique(rng.integers(0, top, 300))
        coded = postings.gaps(x)
        assert (postings.numbers(coded) == x).all()
        assert top > 10_000 or len(coded) <= 2 * len(x)
    assert postings.gaps(np.zeros(0, np.int64)) == b"" and len(postings.numbers(b"")) == 0


def test_term_grams():
    assert postings.term_grams("AbCd") == ["abc", "bcd"] and postings.term_grams("ab%cd_ef") == []
    assert postings.term_grams("abc%xyz") == ["abc", "xyz"]


def test_empty_table_and_parameters(spark, rows, tmp_path):
    postings.store(postings.number(rows.limit(0)), str(tmp_path / "i"))
    assert postings.search_term(*postings.read(spark, str(tmp_path / "i")), "topic").count() == 0
    with pytest.raises(ValueError):
        postings.number(rows, 0)


def test_lists_hold_the_rows_of_each_trigram(monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_LETTERS", 40)
    rng = random.Random(5)
    texts = [(rng.choice([None, "", "ab", "AÉ\0b\U0001f600c"]), "".join(rng.choices("aBc\0é\U0001f600\n ", k=rng.randrange(30)))) for _ in range(90)]
    table = pa.table({"t": pa.array([t for t, _ in texts], pa.string()), "c": [c for _, c in texts]})
    want = {}
    for i, pair in enumerate(texts):
        for gram in set().union(*[postings.grams(postings.fold(t)) for t in pair]):
            want.setdefault(gram, []).append(i)
    found, first, rows = postings._lists(table, ("t", "c"))
    assert {g: list(r) for g, r in zip(found, np.split(rows, first[1:]))} == want and len(found) == len(want)


def test_lists_of_a_large_alphabet():
    every = "".join(chr(c) for c in range(0x400, 0x30000) if not 0xD800 <= c < 0xE000)
    table = pa.table({"t": pa.array([every] + ["\u0400\u0401\u0402"] * 2000)})
    assert len(every) ** 3 * table.num_rows > 1 << 63
    found, first, rows = postings._lists(table, ("t",))
    lists = dict(zip(found, np.split(rows, first[1:])))
    assert len(found) == len(every) - 2 and list(lists[every[:3]]) == list(range(2001)) and list(lists[every[-3:]]) == [0]


def test_store_lists_the_trigrams_once(rows, tmp_path, monkeypatch):
    calls, build = rows.sparkSession.sparkContext.accumulator(0), postings.build

    def counted(*given):
        def run(batches):
            calls.add(1)
            yield from batches

        made = build(*given)
        return made.coalesce(1).mapInArrow(run, made.schema)

    monkeypatch.setattr(postings, "build", counted)
    postings.store(postings.number(rows, 60), str(tmp_path / "i"))
    assert calls.value == 1
