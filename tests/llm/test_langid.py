import random
import zlib

import pytest
from pyspark.sql import functions as F

from docspark.llm import langid, queries

SYLLABLES = {"aa": "ka lo mi tu re so ven".split(), "bb": "dar pil né öt shu gro".split(), "cc": "xin quo wap zel fy jum".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(n=240):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        lang = rng.choice(("aa", "aa", "aa", "bb", "cc"))
        text = prose(rng, lang, rng.randrange(20, 200))
        rows.append((i, text.upper() if i % 9 == 0 else text, lang, "s", "x"))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, score string"


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return queries.QUERIES["op13_language_id"](spark, str(tmp_path)).collect()


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


ODD = [(1000, None), (1001, ""), (1002, "12 345 --- !?"), (1003, "\n\t"), (1004, "̀ ́"), (None, "kaka lolo mimi")]


def test_held_out_accuracy_and_odd_texts(spark, tmp_path):
    rows = corpus() + [(i, t, "aa", "s", None) for i, t in ODD] + [(2000, "kalo " * 30000, "bb", "s", None)]
    got = {r["doc_id"]: r for r in run(spark, tmp_path, rows)}
    assert len(got) == len(rows)
    known = [r for r in corpus() if held_out(r[0])]
    assert all(got[r[0]]["held_out"] == held_out(r[0]) for r in corpus())
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in known) >= 0.98 * len(known)
    assert all((got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True) for i in range(1000, 1005))
    assert got[None]["lang_pred"] in SYLLABLES and got[None]["held_out"] is False
    assert got[2000]["lang_pred"] == "aa"  # the label is no input
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_labels_of_held_out_rows_and_sources_change_nothing(spark, tmp_path):
    rows = corpus(90)
    other = [(i, t, "zz" if held_out(i) else lang, None, x) for i, t, lang, _, x in rows]
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    assert sorted(run(spark, tmp_path / "a", rows)) == sorted(run(spark, tmp_path / "b", other))


def test_prediction_is_the_smallest_encoding(spark):
    docs = spark.createDataFrame(corpus(60), SCHEMA)
    model = langid.learn(docs, F.lit(True))
    assert list(model.content)[0] == "aa" and sorted(model.content) == ["aa", "bb", "cc"]
    compressors = model.compressors()
    normal = {r["doc_id"]: r["t"] for r in docs.select("doc_id", langid.letters(F.col("text")).alias("t")).collect()}
    for r in langid.identify(docs, model).collect():
        sizes = langid.sizes(normal[r["doc_id"]].encode(), compressors)
        assert r["lang_pred"] == list(compressors)[sizes.index(min(sizes))]
        low, next_ = sorted(sizes)[:2]
        assert r["score"] == pytest.approx(1 - low / next_) and r["accepted"] == (r["score"] >= langid.MARGIN)


def test_bounds_of_the_sample(spark):
    rows = [(i, prose(random.Random(i), "aa", 400), "aa", "s", "x") for i in range(600)] + [(9999, "né né", "bb", "s", "x")]
    model = langid.learn(spark.createDataFrame(rows, SCHEMA), F.lit(True), sample_rows=10, sample_chars=50)
    assert len(model.content["aa"].decode()) <= 10 * 51 and model.content["bb"] == "né né".encode()
    assert list(langid.learn(spark.createDataFrame(rows, SCHEMA), F.lit(True), languages=1).content) == ["aa"]


def test_nothing_learned_one_language_and_empty(spark, tmp_path):
    docs = spark.createDataFrame([(1, "ka lo", None, "s", "x"), (2, "ka lo", "aa", "s", "x")], SCHEMA)
    none = langid.identify(docs, langid.learn(docs, F.lit(False))).collect()
    assert [(r["lang_pred"], r["score"], r["accepted"]) for r in none] == [("und", 0.0, False)] * 2
    one = langid.identify(docs, langid.learn(docs, F.lit(True))).collect()
    assert [(r["lang_pred"], r["score"]) for r in one] == [("aa", 1.0)] * 2
    assert run(spark, tmp_path, []) == []
