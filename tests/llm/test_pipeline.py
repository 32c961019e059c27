from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm.brute import components, words
from tests.llm.test_mixing import water
from tests.llm.test_quality import plain as judged
from tests.llm.test_substrings import plain as cleaned
from tests.llm.test_tokens import ENCODER
from tests.llm.texts import corpus

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns for one small table."""
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in corpus(seed=21, n=60).items()], SCHEMA)
    out = [("documents", docs.collect())]
    for name, apply in corpus_pipeline.STAGES:
        got = apply(spark, docs, "")
        rows = got.collect()
        out.append((name, rows))
        docs = spark.createDataFrame(rows, got.schema)
    return dict(out)


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "substring_dedup", "source_mixing", "sequence_packing"]


def test_quality_keeps_what_the_rules_keep(stages):
    want = [r for r in stages["documents"] if judged(r["text"])["kept"]]
    assert sorted(stages["quality_rules"]) == sorted(want)


def test_one_document_of_a_group_stays(stages):
    found = components({r["doc_id"]: r["text"] for r in stages["quality_rules"]})
    assert sorted(stages["near_duplicates"]) == sorted(r for r in stages["quality_rules"] if found[r["doc_id"]][1] == r["doc_id"])


def test_passages_are_cut(stages):
    rows = sorted(stages["near_duplicates"])
    texts = cleaned([(r["doc_id"], r["text"]) for r in rows])
    got = sorted(stages["substring_dedup"])
    assert [r["text"] for r in got] == texts and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]


def test_sources_come_near_their_targets(stages):
    size, taken = {}, {}
    for name, sums in (("substring_dedup", size), ("source_mixing", taken)):
        for r in stages[name]:
            sums[r["source"]] = sums.get(r["source"], 0) + len(words(r["text"]))
    goal = water(size, dict(zip(sorted(size), (5, 2, 1), strict=True)), 3)
    assert all(abs(taken.get(s, 0) - goal[s]) <= 30 for s in size)
    assert set(stages["source_mixing"]) <= set(stages["substring_dedup"])


def test_everything_is_packed(stages):
    texts = {r["doc_id"]: r["text"] for r in stages["source_mixing"]}
    copies = Counter(r["doc_id"] for r in stages["source_mixing"])
    placed, pieces = defaultdict(list), Counter()
    for r in stages["sequence_packing"]:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["piece"]] += 1
    assert all(n == copies[doc] for (doc, _), n in pieces.items()) and {doc for doc, _ in pieces} == set(texts)
    for parts in placed.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    tokens = sum(n * (len(ENCODER.encode([texts[doc] or ""])[0]) // 4 + 1) for doc, n in copies.items())
    assert sum(r["length"] for r in stages["sequence_packing"]) == tokens


def test_run_over_the_table(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows.count() > 100


def test_stages_take_extra_columns_with_the_names_used_inside(spark):
    """Whatever else a table holds comes through the filtering stages unchanged."""
    extra = ["row", "key", "_bits", "_block", "copied", "class", "size", "_order", "picked", "id"]
    texts = list(corpus(seed=21, n=20).items()) + [(None, corpus(seed=21, n=20)[0]), (None, None)]
    rows = [(i, t, "en", f"s{n % 3}", len(t or ""), *[f"{c}{n}" for c in extra]) for n, (i, t) in enumerate(texts)]
    schema = SCHEMA + "".join(f", `{c}` string" for c in extra)
    docs = spark.createDataFrame(rows, schema)
    told = {r[5]: r[5:] for r in rows}
    for name, apply in corpus_pipeline.STAGES[:-1]:
        got = apply(spark, docs, "")
        kept = got.collect()
        assert got.columns == docs.columns and kept and all(tuple(r)[5:] == told[r["row"]] for r in kept), name
        docs = spark.createDataFrame(kept, got.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len(packed) >= len(kept)
