from collections import Counter

from docspark.llm import quality
from tests.llm.brute import WORD, words
from tests.llm.texts import corpus


def plain(text):
    text = text or ""
    w = words(text)
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, out["n_dup_lines"], out["dup_line_chars"], out["n_lines"] = set(), 0, 0, len(lines)
    for x in lines:
        if x in seen:
            out["n_dup_lines"] += 1
            out["dup_line_chars"] += sum(map(len, words(x)))
        seen.add(x)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    out["n_repeat_words"] = len({j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 3)})
    for k in quality.COVERAGE:
        seen, inside = set(), set()
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            if g in seen:
                inside.update(range(i, i + k))
            seen.add(g)
        out[f"dup_chars_{k}"] = sum(len(w[j]) for j in inside)
    out["base_failed"] = out["n_words"] < 50 or 100 * out["n_repeat_words"] > 50 * out["n_words"]
    bad = 100 * out["n_dup_lines"] > 30 * out["n_lines"] or 100 * out["dup_line_chars"] > 20 * out["word_chars"]
    bad = bad or any(100 * out[f"dup_chars_{k}"] > p * out["word_chars"] for k, p in quality.COVERAGE.items())
    out["kept"] = not out["base_failed"] and not bad
    return out


def test_counts_and_verdicts_match_plain_python(spark):
    texts = corpus()
    half = texts[4].split()
    texts[1000] = " ".join(half + half[: len(half) // 4])  # repeats a part
    texts[1001] = "\n".join(["p q r s t u v w", texts[5], "p q r s t u v w", "\r", "p q r s t u v w "])
    docs = spark.createDataFrame([(i, t, "n") for i, t in texts.items()], "doc_id long, text string, n_words string")
    got = {r["doc_id"]: r.asDict() for r in quality.judge(docs).collect()}
    assert {i: {k: v for k, v in r.items() if k != "doc_id"} for i, r in got.items()} == {i: plain(t) for i, t in texts.items()}
    assert any(r["kept"] for r in got.values()) and not got[1000]["kept"]


def test_keep_returns_whole_rows(spark):
    texts = corpus()
    rows = [(i, t, i * 2) for i, t in texts.items()] + [(None, texts[3], None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept long")
    got = sorted(map(tuple, quality.keep(docs).collect()), key=str)
    assert got == sorted([r for r in rows if plain(r[1])["kept"]], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.judge(docs).count() == 0 and quality.keep(docs).count() == 0


def test_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert "Exchange" not in quality.judge(docs)._jdf.queryExecution().toString()
