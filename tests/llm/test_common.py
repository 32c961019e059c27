import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docspark.llm.common import Texts, numbered, slices, window_hashes
from tests.llm.brute import words

LETTERS = st.text(alphabet="ab \n\té ", max_size=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), LETTERS), max_size=8), st.integers(0, 3))
def test_words_and_hashes_depend_on_the_text_only(values, skip):
    texts = Texts(pa.array(values, pa.string()).slice(min(skip, len(values))))
    values = values[skip:]
    starts, ends, owner = texts.words()
    found = [bytes(texts.data[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    assert found == [w for v in values for w in words(v)]
    assert owner.tolist() == [i for i, v in enumerate(values) for _ in words(v)]
    hashes = texts.hashes(starts, ends).tolist()
    assert len(set(zip(found, hashes, strict=True))) == len(set(found)) == len(set(hashes))
    windows, first = window_hashes(texts.hashes(starts, ends), owner, 2)
    pairs = [tuple(found[i : i + 2]) for i in first.tolist()]
    assert len(set(pairs)) == len(set(zip(pairs, windows.tolist(), strict=True))) == len(set(windows.tolist()))


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 0, 30, 1, 1, 9)] + [None], "i": list(range(7))})
    parts = list(slices(iter([batch, batch.slice(0, 0)]), "text", 10))
    assert [x for p in parts for x in p.column("i").to_pylist()] == list(range(7)) and len(parts) > 2
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 10 for p in parts)


def test_numbers_are_gapless(spark):
    rows = spark.range(1000).withColumn("g", F.col("id") % 3)
    got = numbered(rows, ["g"], F.xxhash64("id"), ["id"], "n", buckets=16).collect()
    for g in range(3):
        own = [r["n"] for r in got if r["g"] == g]
        assert sorted(own) == list(range(len(own)))
