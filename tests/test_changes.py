"""Encoding by change: the hash tree and the refreshed index."""

import random

import pytest
from pyspark.sql import functions as F

from docspark.operators import changes, chunking
from docspark.plans import flows
from docspark.session import stage

SCHEMA = "source_path string, id string, document string"


@pytest.mark.parametrize("buckets", [1, 4, 256])
def test_changes_equal_a_plain_comparison(spark, buckets):
    rng = random.Random(buckets)
    old = {f"{d}-{c}": (f"d{d}", f"text {rng.random()}") for d in range(30) for c in range(rng.randrange(1, 9))}
    old |= {"n-1": (None, "a"), "n-2": (None, "b")}
    new = dict(old)
    for key in rng.sample(sorted(old), 20):
        new[key] = (old[key][0], "other")
    for key in rng.sample(sorted(new), 15):
        del new[key]
    new |= {f"new-{k}": (f"d{rng.randrange(40)}", None if k % 3 else "fresh") for k in range(12)}
    frames = [spark.createDataFrame([(p, i, t) for i, (p, t) in x.items()], SCHEMA) for x in (new, old)]
    got = {r["id"]: (r["source_path"], r["change"]) for r in changes.index_changes(*frames, buckets).collect()}
    want = {}
    for i in old.keys() | new.keys():
        what = "added" if i not in old else "removed" if i not in new else "kept" if (old[i][1] or "") == (new[i][1] or "") else "changed"
        want[i] = ((new.get(i) or old[i])[0], what)
    assert got == want


def test_equal_versions_and_empty_ones(spark):
    rows = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y")], SCHEMA)
    assert {r["change"] for r in changes.index_changes(rows, rows).collect()} == {"kept"}
    assert {r["change"] for r in changes.index_changes(rows, rows.limit(0)).collect()} == {"added"}
    assert {r["change"] for r in changes.index_changes(rows.limit(0), rows).collect()} == {"removed"}
    assert changes.index_changes(rows.limit(0), rows.limit(0)).count() == 0


def test_only_changed_chunks_are_encoded(spark, tmp_path):
    counter = spark.sparkContext.accumulator(0)

    def make():
        def encode(texts):
            counter.add(len(texts))
            return [[float(len(t)), 1.0] for t in texts]

        return encode

    encoder, path = flows.Encoder(make, 2, "lengths"), str(tmp_path / "index")

    def run(texts, encoder=encoder):
        docs = spark.createDataFrame(list(texts.items()), "source_path string, text string")
        records = stage(chunking.topic_records(docs, chunking.ChunkConfig(), F.lit("2026-01-01 00:00:00").cast("timestamp"), empty_blocks=True))
        before = counter.value
        found = flows.refresh_index(*flows.knowledge_base(records), encoder, path, docs)
        changed = sorted((r["source_path"], r["change"]) for r in found.collect())
        return changed, counter.value - before

    first = {"a.md": "# A\n## One\nfirst\n## Two\nsecond\n", "b.md": "# B\n## One\nbody\n"}
    assert run(first) == ([("a.md", "added")] * 2 + [("b.md", "added")], 3)
    assert run(first) == ([("a.md", "kept")] * 2 + [("b.md", "kept")], 0)
    # one chunk of one document changes, one comes, one document goes; the other is not part of the run
    assert run({"a.md": "# A\n## One\nfirst\n## Two\nother words\n## Three\nmore\n"}) == ([("a.md", "added"), ("a.md", "changed"), ("a.md", "kept")], 2)
    index = flows.read_index(spark, path, encoder)
    rows = {r["document"].split("\n")[-1]: r for r in index.collect()}
    assert sorted(rows) == ["body", "first", "more", "other words"]
    assert all(r["embedding"][0] == len(r["document"]) for r in rows.values())
    assert run({"b.md": "Bare title\n"}) == ([("b.md", "removed")], 0)
    assert flows.read_index(spark, path, encoder).count() == 3
    other = flows.Encoder(make, 2, "another model")
    assert run({"a.md": "# A\n## One\nfirst\n## Two\nother words\n## Three\nmore\n"}, other) == ([("a.md", "changed")] * 3, 3)
