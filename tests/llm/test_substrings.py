import random

import pyarrow as pa

from docspark.llm import substrings
from docspark.session import stage
from tests.llm.brute import words
from tests.llm.texts import corpus, sentence


def chunk_words(text):
    """First and end word of every chunk, by a plain loop with the rolling hash byte by byte."""
    data = (text or "").encode()
    mask = (1 << 64) - 1
    blank = {0x20, *range(0x09, 0x0E)}
    ends, starts = [], []
    for i, b in enumerate(data):
        if b not in blank and (i == 0 or data[i - 1] in blank):
            starts.append(i)
        if b not in blank and (i + 1 == len(data) or data[i + 1] in blank):
            ends.append(i + 1)
    cuts, first = [], 0
    for w, end in enumerate(ends):
        h = 0
        for b in data[max(0, end - 16) : end]:
            h = (2 * h + int(substrings._GEAR[b])) & mask
        if end >= 16 and h >> 62 == 0 and w + 1 - first >= substrings.MIN_CHUNK_WORDS:
            cuts.append((first, w + 1))
            first = w + 1
    if first < len(ends):
        cuts.append((first, len(ends)))
    return [(a, b, data[starts[a] : ends[b - 1]], starts[a]) for a, b in cuts]


def plain(rows):
    """Deduplicated texts of rows (id, text); no id counts as the largest."""
    last = float("inf")
    first = {}
    cut = [chunk_words(t) for _, t in rows]
    for (i, _), chunks in zip(rows, cut, strict=True):
        for *_, body, _ in chunks:
            first[body] = min(first.get(body, last), last if i is None else i)
    out = []
    for (i, text), chunks in zip(rows, cut, strict=True):
        seen, copied = set(), []
        for *_, body, _ in chunks:
            copied.append(first[body] < (last if i is None else i) or body in seen)
            seen.add(body)
        data, kept, k, at = (text or "").encode(), b"", 0, 0
        while k < len(chunks):
            end = k
            while end < len(chunks) and copied[end]:
                end += 1
            if end > k and chunks[end - 1][1] - chunks[k][0] >= substrings.MIN_RUN_WORDS:
                kept += data[at : chunks[k][3]]
                at = chunks[end][3] if end < len(chunks) else len(data)
            k = max(end, k + 1)
        out.append(None if text is None else (kept + data[at:]).decode())
    return out


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, copied string, id int")
    got = substrings.deduplicate(docs, stage)
    assert got.columns == docs.columns
    return got.collect()


def test_result_matches_plain_python(spark):
    rows = list(corpus(seed=9).items()) + [(None, corpus(seed=9)[0]), (None, "fresh words only")]
    got = run(spark, rows)
    want = [(i, t) for (i, _), t in zip(rows, plain(rows), strict=True)]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)
    assert any(t != n for (_, t), (_, n) in zip(rows, want, strict=True))


def test_passage_goes_from_all_but_the_first(spark):
    rng = random.Random(4)
    passage = sentence(rng, 60)
    rows = [(i, f"{sentence(rng, 90 + i)} {passage} {sentence(rng, 70)}") for i in range(6)]
    clean = [(100 + i, sentence(rng, 200)) for i in range(10)]
    got = {r["doc_id"]: r["text"] for r in run(spark, rows + clean)}
    assert got[0] == rows[0][1] and all(got[i] == t for i, t in clean)
    for i, text in rows[1:]:
        assert passage not in got[i] and len(words(text)) - 62 <= len(words(got[i])) <= len(words(text)) - 35


def test_insertion_shifts_nothing():
    rng = random.Random(8)
    text = sentence(rng, 400)
    a = substrings.Chunks(pa.array([text]))
    b = substrings.Chunks(pa.array(["new words " + text]))
    assert len(set(a.digests.tolist()) & set(b.digests.tolist())) >= len(a.digests) - 2


def test_runs_without_a_cut_meet(spark):
    rng = random.Random(6)
    # a word whose repetition never ends a chunk by itself
    word = next(w for w in (f"junk{k}" for k in range(100)) if max(b - a for a, b, *_ in chunk_words(f"{w} " * 200)) > 150)
    rows = [(i, f"{sentence(rng, 90 + i)} {f'{word} ' * (200 + 9 * i)}{sentence(rng, 90)}") for i in range(4)]
    got = {r["doc_id"]: r["text"] for r in run(spark, rows)}
    assert got[0] == rows[0][1]
    for i, text in rows[1:]:
        left = words(got[i]).count(word)
        assert left <= 100 and len(words(got[i])) - left >= 180 + i
    cut = substrings.Chunks(pa.array([text for _, text in rows]))
    assert (cut.end - cut.first).max() <= 32


def test_spans_and_counts(spark):
    rng = random.Random(4)
    rows = [(1, text := sentence(rng, 100) + " né"), (2, "own start of it " + text + " own end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in substrings.deduplicate(docs, stage, spans=True).collect()}
    span = got[2]["_spans"][0]
    old = rows[1][1]
    assert old[: span["start"]] + old[span["start"] + span["length"] :] == got[2]["text"]
    assert got[2]["_removed_words"] == len(words(old)) - len(words(got[2]["text"])) and got[2]["_words"] == len(words(old))
    assert got[1]["_spans"] == [] and got[1]["_removed_words"] == 0


def test_copies_under_one_id_stay(spark):
    text = sentence(random.Random(1), 80)
    got = run(spark, [(1, text), (1, text), (2, text)])
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, text), (1, text), (2, "")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.deduplicate(docs, stage).count() == 0


def test_rows_without_id_and_texts_under_one_id_are_deduplicated(spark):
    rng = random.Random(21)
    passages = [sentence(rng, 80) for _ in range(3)]
    body = lambda: sentence(rng, 70)
    rows = [(None, f"{body()} {passages[0]} {body()}") for _ in range(3)]
    rows += [(5, f"{body()} {passages[1]} {body()}") for _ in range(2)]
    rows += [(None, f"{body()} {passages[2]} {body()}"), (9, f"{body()} {passages[2]} {body()}")]
    got = [(r["doc_id"], r["text"]) for r in run(spark, rows)]
    assert len(got) == 7
    for p, holders in zip(passages, (3, 2, 2), strict=True):
        core = " ".join(p.split()[15:-15])
        assert sum(core in t for _, t in got) == 1 < holders
    assert passages[2] in next(t for i, t in got if i == 9)  # the row with an id comes first


def test_a_hot_id_gathers_nothing(spark):
    """Ten thousand rows without id: the digests of a row stay with the row."""
    rng = random.Random(22)
    passage = sentence(rng, 40)
    rows = [(None, f"{sentence(rng, 12)} {passage if i % 50 == 0 else ''} {sentence(rng, 12)}") for i in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    copied = substrings.copied_digests(docs, stage).collect()
    longest = max(len(r["copied"]) for r in copied)
    assert len(copied) >= 190 and longest <= 40
    core = " ".join(passage.split()[10:-10])
    kept = [r["text"] for r in substrings.deduplicate(docs, stage).collect()]
    assert len(kept) == 10_000 and sum(core in t for t in kept) == 1


def test_very_long_texts(spark):
    rng = random.Random(23)
    long = sentence(rng, 60_000)
    got = {r["doc_id"]: r["text"] for r in run(spark, [(1, long), (2, "a b c " + long), (3, sentence(rng, 50))])}
    assert got[1] == long and len(words(got[2])) < 40 and len(words(got[3])) == 50
